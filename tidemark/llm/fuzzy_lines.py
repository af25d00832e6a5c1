"""Near-equal lines across documents: SimHash, pigeonhole blocks, edit similarity."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.tables import texts
from tidemark.sources.scratch import discard, freeze, freeze_alone, spread

# Lines of (from how many distinct words, blocks, blocks in a key, least words in a key).
SHORT = [(0, 6, 3, 2), (10, 5, 2, 3)]
# Longer ones: keys of one block of four words or more, of 5 to 10 words on average.
LONG = [(24 if m == 4 else 5 * m, m, 1, 4) for m in (4, 8, 16, 32, 64)]
TIERS = SHORT + LONG
# The words with the smallest hashes stand for a line of more.
SKETCH = 5 * TIERS[-1][1]
# Votes for a bit are counted in so many binary digits, enough for blocks of 63 words.
_DIGITS = 5


def _raw_lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _normal(line: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.expr(line)), r"[^\p{L}\p{N}]+", " "))


def _keyed(norm: DataFrame) -> DataFrame:
    """A 128-bit key of column ``norm`` in two halves."""
    return norm.withColumns({"h": F.xxhash64("norm"), "g": F.xxhash64(F.lit(7), "norm")})


def block_simhash(words: str) -> str:
    """SQL: the 64-bit SimHash of an array of up to 63 word hashes, a bit set where more than half the words have it.

    The votes of all bits are counted at once: digit ``k`` of every count stands
    in one long, and a word is added with the carry going from long to long.  Counts
    start so high that more than half the votes carry out of the last digit.
    """
    start, carry, digits = [], "h", []
    for k in range(_DIGITS):
        start.append(f"'d{k}', -(shiftright({2**_DIGITS - 1} - size({words}) div 2, {k}) & 1L)")
        digits.append(f"'d{k}', v.d{k} ^ ({carry})")
        carry = f"v.d{k} & ({carry})"
    added = f"named_struct({', '.join(digits)}, 'over', v.over | ({carry}))"
    return f"aggregate({words}, named_struct({', '.join(start)}, 'over', 0L), (v, h) -> {added}, v -> v.over)"


def _blocks(blocks: int) -> str:
    """SQL: the word hashes ``ws`` dealt to ``blocks`` arrays, many of them in two steps."""
    if blocks < 8:
        return f"transform(sequence(0, {blocks - 1}), b -> filter(ws, h -> pmod(h, {blocks}) = b))"
    outer = 8 if blocks >= 64 else 4
    inner = f"transform(sequence(0, {blocks // outer - 1}), b -> filter(w, h -> pmod(h div {outer}, {blocks // outer}) = b))"
    parts = f"transform(sequence(0, {outer - 1}), b -> filter(ws, h -> pmod(h, {outer}) = b))"
    return f"flatten(transform({parts}, w -> {inner}))"


def _tier_keys(blocks: int, chosen: int, least: int) -> Column:
    """Keys of one tier from the sorted word hashes ``ws``: hashes of all choices of ``chosen`` blocks."""
    sims = f"transform({_blocks(blocks)}, x -> named_struct('n', size(x), 'sim', if(size(x) > 0, {block_simhash('x')}, 0L)))"
    if chosen == 1:
        kept = f"filter(transform({sims}, (x, i) -> if(x.n >= {least}, xxhash64({blocks}, i, x.sim), null)), k -> k is not null)"
        return F.expr(kept)
    choices = []
    for at in combinations(range(blocks), chosen):
        words = " + ".join(f"s[{i}].n" for i in at)
        choices.append(f"if({words} >= {least}, xxhash64({blocks}, {', '.join(f'{i}, s[{i}].sim' for i in at)}), null)")
    # a lambda over the one element array, so that the blocks are hashed once
    return F.expr(f"filter(transform(array({sims}), s -> array({', '.join(choices)}))[0], k -> k is not null)")


def line_keys(lines: DataFrame) -> DataFrame:
    """Adds the candidate ``keys`` of each normalised line ``norm``, an array of longs.

    Every distinct word belongs to one block by its hash, and a block's SimHash is
    voted by its own words.  A changed word disturbs at most the block it leaves and
    the one it enters, so by the pigeonhole principle ``t`` changed words leave all
    but ``2 t`` blocks alike.  How many blocks there are and how many make a key goes
    by the number of distinct words (``TIERS``); a line within a tenth of the next
    tier has the keys of that too.  So a line's keys depend on the line alone.
    """
    words = F.transform(F.array_distinct(F.split("norm", " ")), lambda w: F.xxhash64(w))
    lines = lines.withColumn("ws", F.slice(F.sort_array(words), 1, SKETCH))
    none = F.array().cast("array<bigint>")
    parts = []
    for i, (low, blocks, chosen, least) in enumerate(TIERS):
        upper = TIERS[i + 1][0] if i + 1 < len(TIERS) else SKETCH + 1
        here = F.expr(f"size(ws) * 10 >= {9 * low} and size(ws) < {upper}")
        parts.append(F.when(here, _tier_keys(blocks, chosen, least)).otherwise(none))
    return lines.withColumn("keys", F.array_distinct(F.concat(*parts))).drop("ws")


def fuzzy_lines(docs: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line with a letter or digit: ``doc_id, line_no, class_doc_id, class_line_no, kept``.

    Lines are compared in lower case with every run of other characters than
    letters and digits as one space.  Two lines are linked if they are equal, or if they agree
    on a key of SimHash blocks (``line_keys``), share a third of their distinct words, and their edit
    similarity (1 - Levenshtein distance / longer length) is at least ``percent``
    hundredths.  The class of a line is the first line, by document id and line
    number, of its connected group; that line alone is kept.

    Only keys are shuffled, about one for six words of a line and at most 32 for
    a line under 24 words.  Equal lines become one node first.  In every bucket
    all members are compared with its first member; those it does not connect are
    compared with the members of other groups, so that no bucket is expanded into
    all pairs and no link between groups is lost.  Texts are read again for
    candidate lines alone.

    Defined cases: lines without letters or digits are layout, never compared and
    not in the result; lines of one word are linked if equal only; null and empty texts have
    no lines; a null document id sorts first; rows with equal ids and equal lines at one place are
    one line given twice; an empty table gives an empty result; other columns are ignored.
    """
    rows = spread(texts(docs, id_col, text_col))
    # the raw line decides, so that it is normalised once and not for the filter too
    norm = _raw_lines(rows).where(F.col("line").rlike(r"[\p{L}\p{N}]")).select("doc_id", "line_no", _normal("line").alias("norm"))
    keyed = line_keys(_keyed(norm)).select("doc_id", "line_no", "h", "g", F.length("norm").alias("chars"), "keys")
    lines = freeze(keyed, "lines")
    kinds = lines.groupBy("h", "g").agg(
        F.min(F.struct("doc_id", "line_no")).alias("first"), F.any_value("chars").alias("chars"), F.any_value("keys").alias("keys")
    )
    kinds = freeze(kinds.withColumn("id", F.monotonically_increasing_id()), "line-kinds")
    # the keys are read once, what they belong to at the end again
    places = freeze(lines.select("doc_id", "line_no", "h", "g"), "line-places")
    discard(lines)

    # rows are dealt out by key once, and each bucket of several lines is written with its first member
    bucket = Window.partitionBy("key")
    blocks = kinds.select(F.explode("keys").alias("key"), "id", "chars").withColumns(
        {"pivot": F.min(F.struct("id", "chars")).over(bucket), "n": F.count(F.lit(1)).over(bucket)}
    )
    crowded = blocks.where("n > 1").select("key", "id", "chars", F.col("pivot.id").alias("pivot"), F.col("pivot.chars").alias("pivot_chars"), "n")
    crowded = freeze(crowded, "crowded-blocks")
    met = crowded.where("id > pivot").where(_near_length("struct(pivot_chars as chars)", "struct(chars)", percent))
    first = freeze(met.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "line-pairs")
    # two lines alone in a bucket are a pair by themselves
    members = freeze(crowded.where("n > 2").drop("n"), "block-members")
    discard(crowded)
    # one member of a crowded bucket may meet any other later on
    named = first.select(F.explode(F.array("a", "b")).alias("id")).unionByName(members.select("id")).distinct()
    candidates = freeze(kinds.join(named, "id", "left_semi").select("id", "first", "h", "g"), "candidate-lines")
    line_texts = _texts(rows, candidates)
    links = freeze(_similar(line_texts, first, percent), "line-links")
    labels = freeze_alone(lambda: components(links), "line-groups")

    marked = members.join(labels, members["id"] == labels["node"], "left").withColumn("component", F.coalesce("component", "id")).drop("node")
    main = marked.where("id = pivot").select("key", F.col("component").alias("main"))
    marked = freeze(marked.join(main, "key").withColumn("apart", F.expr("component <> main")), "marked-blocks")
    discard(candidates, members)
    rest = marked.where("apart").alias("m").join(
        marked.alias("p"), F.expr("m.key = p.key and m.component <> p.component and (not p.apart or m.id < p.id)") & _near_length("m", "p", percent)
    )
    second = rest.select(F.least("m.id", "p.id").alias("a"), F.greatest("m.id", "p.id").alias("b")).distinct()
    second = freeze(second.join(first, ["a", "b"], "left_anti"), "line-pairs")
    discard(first, marked)
    if not second.isEmpty():
        discard(labels)
        labels = freeze_alone(lambda: components(links.unionByName(_similar(line_texts, second, percent))), "line-groups")
    discard(second, line_texts, links)

    grouped = kinds.join(labels, kinds["id"] == labels["node"], "left").withColumn("component", F.coalesce("component", "id"))
    grouped = freeze(grouped.select("h", "g", "first", "component"), "line-classes")
    discard(kinds, labels)
    heads = grouped.groupBy("component").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    classes = grouped.join(heads, "component", "left").select("h", "g", F.coalesce("head", "first").alias("head"))
    found = places.join(classes, ["h", "g"])
    here = F.struct("doc_id", "line_no")
    return found.select(
        "doc_id", "line_no", F.col("head.doc_id").alias("class_doc_id"), F.col("head.line_no").alias("class_line_no"),
        here.eqNullSafe(F.col("head")).alias("kept"),
    )


def _near_length(a: str, b: str, percent: int) -> Column:
    """Whether the lengths alone allow the edit similarity."""
    return F.expr(f"100 * least({a}.chars, {b}.chars) >= {percent} * greatest({a}.chars, {b}.chars)")


def _texts(rows: DataFrame, involved: DataFrame) -> DataFrame:
    """``id, norm`` of the candidate lines, from one more pass over their documents.

    The documents are shuffled once, by their id and at any size of the table, and only the lines asked for leave the join.
    """
    wanted = involved.select("id", F.col("first.doc_id").alias("of"), F.col("first.line_no").alias("at"), F.col("h").alias("wh"), F.col("g").alias("wg"))
    cut = rows.select("doc_id", F.split("text", "\n").alias("lines"))
    some = cut.join(wanted.hint("merge"), cut["doc_id"].eqNullSafe(wanted["of"])).where("at < size(lines)")
    some = some.select("id", "wh", "wg", _normal("lines[at]").alias("norm"))
    # rows with equal ids have several lines at one place
    read = _keyed(some).where("h = wh and g = wg").select("id", "norm").distinct()
    return freeze(read, "candidate-texts", compression="zstd")


def aligned_cost(xs: str, ys: str) -> str:
    """SQL: an upper bound of the edit distance of two lines, from their words.

    Words are laid side by side from the front up to some place and from the back
    behind it, whichever place is best; unequal ones count as replaced whole, and the
    words that one line has more as the longest of its words.
    """
    n = f"least(size({xs}), size({ys}))"
    cost = f"zip_with(slice({xs}, {{0}}, {{1}}), slice({ys}, {{2}}, {{1}}), (v, w) -> if(v = w, 0, greatest(length(v), length(w))))"
    front, back = cost.format(1, n, 1), cost.format(f"size({xs}) - {n} + 1", n, f"size({ys}) - {n} + 1")
    switch = "(s, c) -> struct(s.f + c.f as f, least(s.f, s.b) + c.b as b)"
    best = f"aggregate(zip_with({front}, {back}, (f, b) -> struct(f, b)), struct(0 as f, 0 as b), {switch}, s -> least(s.f, s.b))"
    more = f"abs(size({xs}) - size({ys})) * (1 + coalesce(array_max(transform(if(size({xs}) > size({ys}), {xs}, {ys}), w -> length(w))), 0))"
    return f"{best} + {more}"


def _similar(line_texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose lines have the edit similarity.

    Words laid side by side settle most; the others take the Levenshtein distance, in bands that widen.
    """
    both = pairs.join(line_texts.toDF("a", "x"), "a").join(line_texts.toDF("b", "y"), "b")
    both = both.withColumn("most", F.expr(f"cast(floor(greatest(length(x), length(y)) * {100 - percent} / 100) as int)"))
    both = both.where("abs(length(x) - length(y)) <= most")
    alike = "size(array_intersect(p.xs, p.ys)) * 3 >= greatest(size(array_distinct(p.xs)), size(array_distinct(p.ys)))"
    near = f"{aligned_cost('p.xs', 'p.ys')} <= most"
    for band in (32, 128):
        near += f" or (most > {band // 4} and levenshtein(x, y, least(most, {band})) >= 0)"
    near += " or ((most <= 8 or most > 128) and levenshtein(x, y, most) >= 0)"
    # a lambda over the one element array, so that lines are cut into words once and not wherever words are named
    words = "array(struct(split(x, ' ') as xs, split(y, ' ') as ys))"
    return both.where(f"exists({words}, p -> {alike} and ({near}))").select("a", "b")


def drop_lines(docs: DataFrame, decisions: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that ``fuzzy_lines`` does not keep.

    A document all of whose lines with letters or digits were dropped leaves; one
    that had none to begin with stays.  A null text stays null.
    """
    dropped = F.when(~F.col("kept"), F.col("line_no"))
    cuts = decisions.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(dropped).alias("_gone"), F.count_if(F.col("kept")).alias("_left"))
    cuts = cuts.where(F.size("_gone") > 0)
    marked = docs.join(cuts, docs[id_col].eqNullSafe(F.col("_id")), "left").where("_left is null or _left > 0")
    # a column of its own, so that the text is split once and not for each line
    marked = marked.withColumn("_lines", F.when(F.col("_gone").isNotNull(), F.split(F.col(text_col), "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    text = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    return marked.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(text)).select(*docs.columns)
