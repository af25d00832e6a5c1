"""The registered queries of this subpackage, each over a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chat import repair_roles
from tidemark.llm.exact_copies import exact_copies
from tidemark.llm.fingerprints import near_fingerprints
from tidemark.llm.fuzzy_lines import fuzzy_lines
from tidemark.llm.languages import identify, learn_languages, learnable
from tidemark.llm.leaks import leaks
from tidemark.llm.licenses import license_scan
from tidemark.llm.near_copies import near_copies
from tidemark.llm.packing import pack
from tidemark.llm.passages import repeated_passages
from tidemark.llm.ranking import ranked_search
from tidemark.llm.structure import repair_structure, repaired_digests
from tidemark.llm.token_files import read_documents, write_token_files
from tidemark.sources.scratch import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    files = write_token_files(table(spark, sf_dir, "documents"), tokenizer, end_id=0)
    return read_documents(spark, files)


@query("op8_pack")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer, window=4096, end_id=2)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query(
    "op10_exact_dedup",
    """
    select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
           doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
    from documents window g as (partition by coalesce(text, ''))
    """,
)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents"), keep="max")


@query(
    "op9_near_dedup",
    r"""
    with recursive d as (
      select doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
        lambda x: x <> '') as w
      from documents),
    s as (
      select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s
      from d),
    n as (select doc_id, count(*) as n from s group by doc_id),
    p as (
      select x.doc_id as a, y.doc_id as b, count(*) as inter
      from s x join s y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
    l as (
      select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b
      where 100 * inter >= 85 * (x.n + y.n - inter)),
    e as (select a, b from l union all select b, a from l),
    r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on r.b = e.a),
    c as (select a as doc_id, min(b) as component_id from r group by a)
    select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
    from documents join c using (doc_id) left join n using (doc_id)
    """,
)
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"), shingle=3, percent=85)


LEAKS_SQL = r"""
    with i as (
      select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w
      from benchmark),
    wanted as (
      select distinct item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) as s
      from (select *, least(5, len(w)) as k from i where len(w) > 0)),
    sizes as (select item_id, count(*) as n_shingles from wanted group by item_id),
    d as (
      select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w
      from documents),
    own as (
      select distinct doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) as s
      from d, (select distinct k from wanted) where len(w) >= k)
    select doc_id, item_id, n_shingles, count(*) as n_found
    from own join wanted using (s) join sizes using (item_id)
    group by doc_id, item_id, n_shingles having count(*) * 100 >= n_shingles * 80
    """


@query("op7_benchmark_leaks", LEAKS_SQL)
def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_license_scan")
def license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


@query("op6_language_id")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_languages(docs.where(learnable(docs)))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    found = identify(spread(docs.select("doc_id", "text")), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query("op3_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines(table(spark, sf_dir, "documents"))


@query("op2_chat_repair")
def chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_roles(table(spark, sf_dir, "conversations"))


@query("op5_repeated_passages")
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


@query("op11_fingerprints")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_fingerprints(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "kept")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults: by a checksum of conversation and turn, rows are lost, emptied, cut, repeated or given to the user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")), "utf-8")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    marked = turns.withColumn("kind", kind).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2)))).where(F.col("copy") <= times)
    return marked.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"))


@query("op12_structure_repair")
def structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repaired = repair_structure(damaged(turns))
    digests = repaired_digests(repaired.edits).withColumnRenamed("conv_id", "d")
    found = repaired.conversations.withColumnRenamed("conv_id", "c")
    every = turns.select("conv_id").distinct().join(found, F.expr("conv_id <=> c"), "left").join(digests, F.expr("conv_id <=> d"), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return every.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", nothing).alias("repaired_sha256")
    )


@query(
    "op13_ranked_search",
    r"""
    with d as (
      select doc_id, row_number() over () as r, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t
      from documents),
    i as (
      select item_id, row_number() over () as i, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t
      from benchmark),
    q as (select i, item_id, term, count(*) as times from (select i, item_id, unnest(t) as term from i) group by all),
    s as (select count(*) filter (len(t) > 0) as docs, sum(len(t))::bigint as total from d),
    n as (select r, doc_id, 100 - 25 + ((25 * len(t) * docs) // total) as m from d, s where len(t) > 0),
    p as (
      select r, term, count(*) as tf from (select r, unnest(t) as term from d)
      where term in (select term from q) group by r, term),
    f as (select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as weight from p, s group by term),
    c as (
      select q.i, q.item_id, n.doc_id, n.r, sum(q.times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
      from p join q using (term) join f using (term) join n using (r) group by all)
    select item_id, row_number() over (partition by i order by score desc, doc_id)::int as rank, doc_id, score
    from c where score > 0 qualify rank <= 20
    """,
)
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=20)
