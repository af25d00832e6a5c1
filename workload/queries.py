"""Registered queries: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import (
    AllowedValues, Cleaner, ExactDedup, FuzzyDedup, InRange, InferTypes, MissingValues, NormalizeDate,
    NormalizeEmail, NormalizePhone, NormalizeText, Outcome, ParseableDate, Positive, Required, Step, ValidEmail,
    convert, read_report, read_table, report_lines, shape, steps_from_options, write_report, write_table,
)
from tidemark.functions import (
    comparable_text, exact_key, is_blank, is_boolean, is_email, normal_email, normal_phone, parse_date, parse_number,
    token_sort_ratio,
)
from tidemark.operators.fuzzy import FuzzyText
from tidemark.plans.groups import long_form
from tidemark.plans.pairs import Matcher
from tidemark.sources.rowid import ROW_ID
from tidemark.sources.scratch import scratch_path, spread
from tidemark.streaming import clean_stream, dedup_stream, issue_rates

from .dirty import DIRTY_SQL, SCORES_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DATE_FORMATS = ("%m/%d/%Y", "%Y-%m-%d")
PART_THRESHOLD = 80
CUSTOMER_THRESHOLD = 97

PLAN = dict(
    infer_types=True, missing_policy="fill", missing_columns="amount", fill_value="1",
    validate="required,email,date,positive,allowed", required_columns="name,email,signup_date,amount",
    valid_email_columns="email", parseable_date_columns="signup_date", positive_columns="amount",
    allowed_columns="status", allowed_values="active,blocked",
    normalize="text,email,date,phone", text_columns="name,status", text_case="title", email_columns="email",
    date_columns="signup_date", date_input_format=",".join(DATE_FORMATS), phone_columns="phone",
    dedup="exact", dedup_columns="email",
)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Long texts, stored in few row groups, spread over the cores."""
    return spread(load(spark, folder, "documents"), "doc_id").withColumnRenamed("doc_id", ROW_ID)


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Short rows, a million or so in a row group, spread over the cores."""
    return spread(load(spark, folder, "customer"), "c_custkey")


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    text = DIRTY_SQL.replace("from customer", "from {customer}")
    return spark.sql(text, customer=customers(spark, folder)).withColumnRenamed("row_id", ROW_ID)


def scores(spark: SparkSession, folder: str) -> DataFrame:
    text = SCORES_SQL.replace("from customer", "from {customer}")
    return spark.sql(text, customer=customers(spark, folder)).withColumnRenamed("row_id", ROW_ID)


def keyed(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    return load(spark, folder, name).withColumnRenamed(key, ROW_ID)


def data(df: DataFrame, *steps: Step) -> DataFrame:
    return Cleaner(steps).run(df).numbered


def shown(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.col(ROW_ID).alias("row_id"), *columns)


# --- profiling -------------------------------------------------------------


@query
def prf_shape(spark, folder):
    return shape(dirty(spark, folder)).withColumn("column_names", F.array_join("column_names", ","))


@query
def prf_infer(spark, folder):
    return InferTypes().suggestions(dirty(spark, folder))


@query
def prf_override(spark, folder):
    return InferTypes(("amount", "status"), {"amount": "text"}).suggestions(dirty(spark, folder))


@query
def aud_types(spark, folder):
    return Cleaner([InferTypes(("email", "signup_date"))]).run(dirty(spark, folder)).suggestions


# --- normalization ---------------------------------------------------------


def _text_query(name: str, case: str) -> None:
    def run(spark, folder):
        return shown(data(dirty(spark, folder), NormalizeText(["name"], case)), "name")

    def run_documents(spark, folder):
        return shown(data(documents(spark, folder), NormalizeText(["text"], case)), "text")

    QUERIES[name] = run
    QUERIES[f"{name}_documents"] = run_documents


_text_query("nrm_ws", "keep")
_text_query("nrm_lower", "lower")
_text_query("nrm_upper", "upper")
_text_query("nrm_title", "title")


@query
def nrm_email(spark, folder):
    return shown(data(dirty(spark, folder), NormalizeEmail(["email"])), "email")


@query
def nrm_date(spark, folder):
    return shown(data(dirty(spark, folder), NormalizeDate(["signup_date"], DATE_FORMATS)), "signup_date")


@query
def nrm_phone(spark, folder):
    return shown(data(dirty(spark, folder), NormalizePhone(["phone"], "US")), "phone")


def _changes(spark, folder, *steps):
    return Cleaner(steps).run(dirty(spark, folder)).changes


@query
def chg_text(spark, folder):
    return _changes(spark, folder, NormalizeText(["name", "status"], "title"))


@query
def chg_email(spark, folder):
    return _changes(spark, folder, NormalizeEmail(["email"]))


@query
def chg_date(spark, folder):
    return _changes(spark, folder, NormalizeDate(["signup_date"], DATE_FORMATS))


@query
def chg_phone(spark, folder):
    return _changes(spark, folder, NormalizePhone(["phone"], "US"))


@query
def chg_documents(spark, folder):
    run = Cleaner([NormalizeText(["text", "source"])]).run(documents(spark, folder))
    return run.changes.select("row_id", "column", F.md5("before").alias("before"), F.md5("after").alias("after"))


@query
def iss_nrm(spark, folder):
    steps = [NormalizeEmail(["email"]), NormalizeDate(["signup_date"], DATE_FORMATS), NormalizePhone(["phone"], "US")]
    return Cleaner(steps).run(dirty(spark, folder)).issues


# --- missing values --------------------------------------------------------


@query
def mis_keep(spark, folder):
    return shown(data(dirty(spark, folder), MissingValues(["name"])), "name")


@query
def mis_drop(spark, folder):
    return shown(data(dirty(spark, folder), MissingValues(["name", "email"], "drop_rows")), "name", "email")


@query
def mis_fill(spark, folder):
    return _changes(spark, folder, MissingValues(["name", "amount", "signup_date"], "fill", "1"))


def _centre(spark, folder, policy):
    out = data(scores(spark, folder), MissingValues(["score"], policy))
    return out.select(F.col(ROW_ID).alias("row_id"), F.round(F.col("score").cast("double"), 4).alias("score"))


@query
def mis_mean(spark, folder):
    return _centre(spark, folder, "mean")


@query
def mis_median(spark, folder):
    return _centre(spark, folder, "median")


@query
def mis_mode(spark, folder):
    return shown(data(dirty(spark, folder), MissingValues(["email", "name"], "mode")), "email", "name")


# --- validation ------------------------------------------------------------


def _issues(table, *steps):
    return Cleaner(steps).run(table).issues


@query
def val_required(spark, folder):
    return _issues(dirty(spark, folder), Required(["name", "email", "amount", "signup_date"]))


@query
def val_range(spark, folder):
    return _issues(dirty(spark, folder), InRange(["amount"], 0, 5000))


@query
def val_positive(spark, folder):
    return _issues(dirty(spark, folder), Positive(["amount"]))


@query
def val_allowed(spark, folder):
    return _issues(dirty(spark, folder), AllowedValues(["status"], ["active", "BLOCKED"]))


@query
def val_email(spark, folder):
    return _issues(dirty(spark, folder), ValidEmail(["email"]))


@query
def val_date(spark, folder):
    return _issues(dirty(spark, folder), ParseableDate(["signup_date"], DATE_FORMATS))


@query
def val_range_balances(spark, folder):
    return _issues(keyed(spark, folder, "customer", "c_custkey"), InRange(["c_acctbal"], minimum=0, maximum=9000.5))


@query
def val_allowed_orders(spark, folder):
    return _issues(
        keyed(spark, folder, "orders", "o_orderkey"), AllowedValues(["o_orderpriority"], ["1-urgent", "2-high", "5-low"])
    )


@query
def val_lineitem_rates(spark, folder):
    """Issue counts per rule and column over the largest table, with no natural key."""
    lines = load(spark, folder, "lineitem").withColumn(ROW_ID, F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    rules = [InRange(["l_quantity", "l_discount"], 0.02, 40), Positive(["l_tax"])]
    return _issues(lines, *rules).groupBy("column", "rule", "message").agg(F.count(F.lit(1)).alias("issues"))


# --- scalar functions ------------------------------------------------------


@query
def fn_blank(spark, folder):
    return shown(dirty(spark, folder), is_blank(F.col("name")).alias("blank"))


@query
def fn_number(spark, folder):
    return shown(dirty(spark, folder), parse_number(F.col("amount")).alias("number"))


@query
def fn_date(spark, folder):
    return shown(dirty(spark, folder), F.date_format(parse_date(F.col("signup_date"), DATE_FORMATS), "yyyy-MM-dd").alias("d"))


@query
def fn_bool(spark, folder):
    flags = load(spark, folder, "labels").select(
        F.col("doc_id").alias(ROW_ID), F.when(F.col("toxic") == 1, F.lit(" YES ")).otherwise(F.col("quality").cast("string")).alias("v"),
        "quality",
    )
    quality = flags.schema["quality"].dataType
    return shown(flags, is_boolean(F.col("v")).alias("text_flag"), is_boolean(F.col("quality"), quality).alias("number_flag"))


@query
def fn_email(spark, folder):
    return shown(dirty(spark, folder), is_email(normal_email(F.col("email"))).alias("ok"))


@query
def fn_exactkey(spark, folder):
    table = dirty(spark, folder)
    return shown(table, exact_key(F.col("name"), table.schema["name"].dataType).alias("key"))


@query
def fn_comptext(spark, folder):
    table = dirty(spark, folder)
    text = table.schema["name"].dataType
    return shown(table, comparable_text([(F.col("name"), text), (F.col("email"), text)]).alias("text"))


@query
def fn_tokensort(spark, folder):
    score = F.round(token_sort_ratio(F.lower("p_name"), F.lower(F.concat_ws(" ", "p_type", "p_brand"))), 6)
    return load(spark, folder, "part").select("p_partkey", score.alias("score"))


@query
def fn_ratio(spark, folder):
    share = F.count_if(parse_number(F.col("amount")).isNotNull()) / F.count_if(~is_blank(F.col("amount")))
    return dirty(spark, folder).agg(F.round(share, 8).alias("share"))


# --- deduplication ---------------------------------------------------------


@query
def dup_exact(spark, folder):
    return shown(data(dirty(spark, folder), ExactDedup(["email"])), "email", "name")


@query
def dup_exact_groups(spark, folder):
    groups = Cleaner([ExactDedup(["email"])]).run(dirty(spark, folder)).duplicates
    return long_form(groups).select("kept_row", "matched_row", "score", "reason")


@query
def dup_exact_all_columns(spark, folder):
    table = load(spark, folder, "part").withColumnRenamed("p_partkey", ROW_ID).select(ROW_ID, "p_name", "p_brand", "p_type")
    return shown(data(table, ExactDedup()), "p_name", "p_brand", "p_type")


@query
def dup_exact_documents(spark, folder):
    return shown(data(documents(spark, folder), ExactDedup(["text"])), "lang", "n_chars")


@query
def dup_exact_orders(spark, folder):
    groups = Cleaner([ExactDedup(["o_custkey", "o_orderstatus"])]).run(keyed(spark, folder, "orders", "o_orderkey")).duplicates
    return long_form(groups).select("kept_row", "matched_row", "score")


@query
def dup_exact_all_orders(spark, folder):
    orders = keyed(spark, folder, "orders", "o_orderkey")
    return shown(data(orders, ExactDedup()), "o_custkey", "o_orderdate", "o_totalprice")


def _parts(spark, folder):
    return keyed(spark, folder, "part", "p_partkey")


@query
def dup_pairs(spark, folder):
    found = FuzzyText(_parts(spark, folder), ["p_name"]).pairs(Matcher(PART_THRESHOLD))
    return found.select("a", "b", F.round("score", 6).alias("score"))


def _groups(run):
    return long_form(run.duplicates).select("kept_row", "matched_row", F.round("score", 6).alias("score"), "reason")


@query
def dup_suggest(spark, folder):
    return _groups(Cleaner([FuzzyDedup(["p_name"], PART_THRESHOLD)]).run(_parts(spark, folder)))


@query
def dup_strict(spark, folder):
    return shown(data(_parts(spark, folder), FuzzyDedup(["p_name"], PART_THRESHOLD, "remove_strict")), "p_name")


@query
def dup_strict_groups(spark, folder):
    return _groups(Cleaner([FuzzyDedup(["p_name"], PART_THRESHOLD, "remove_strict")]).run(_parts(spark, folder)))


@query
def dup_pairs_customers(spark, folder):
    found = FuzzyText(dirty(spark, folder), ["name", "email"]).pairs(Matcher(CUSTOMER_THRESHOLD))
    return found.select("a", "b", F.round("score", 6).alias("score"))


@query
def dup_pairs_suppliers(spark, folder):
    """Names of one form at a threshold where they are compared in full."""
    named = load(spark, folder, "supplier").select(F.col("s_suppkey").cast("bigint").alias(ROW_ID), "s_name")
    found = FuzzyText(named, ["s_name"]).pairs(Matcher(90))
    return found.select("a", "b", F.round("score", 6).alias("score"))


@query
def dup_own_key(spark, folder):
    """A score of the user's own over blocks of the user's own: names of equal length with the same first word."""
    alike = lambda left, right: F.when(F.length(left) == F.length(right), 100).otherwise(0)
    own = Matcher(50, alike, block_key=lambda text: F.substring_index(text, " ", 1))
    return FuzzyText(_parts(spark, folder), ["p_name"]).pairs(own)


@query
def dup_lsh(spark, folder):
    """Approximate: pairs found by MinHash bands, each with its exact score."""
    found = FuzzyText(dirty(spark, folder), ["name", "email"]).pairs(Matcher(CUSTOMER_THRESHOLD, approximate=True))
    return found.select("a", "b", F.round("score", 6).alias("score"))


@query
def dup_strict_customers(spark, folder):
    step = FuzzyDedup(["name", "email"], CUSTOMER_THRESHOLD, "remove_strict")
    return shown(data(dirty(spark, folder), step), "name", "email")


# Country codes whose numbers have no pattern of their own here.
WORLD_CODES = (
    "20 36 40 51 53 56 57 58 60 62 63 66 84 92 93 94 95 98 211 212 213 216 218 220 221 222 223 224 225 226 227 228 229 230 231 "
    "232 233 234 235 236 237 238 239 240 241 242 243 244 245 248 249 250 251 252 253 254 255 256 257 258 260 261 263 264 265"
).split()


@query
def nrm_phone_world(spark, folder):
    """International numbers of many countries; every fifth is too short."""
    codes = F.array(*map(F.lit, WORLD_CODES))
    key = F.col("c_custkey")
    code = F.get(codes, (key % len(WORLD_CODES)).cast("int"))
    number = F.when(key % 5 == 0, F.lit("12-3")).otherwise(F.concat(F.lit("55 "), F.lpad(key.cast("string"), 6, "0")))
    table = load(spark, folder, "customer").select(key.alias("row_id"), F.concat(F.lit("+"), code, F.lit(" "), number).alias("phone"))
    return table.select("row_id", normal_phone(F.col("phone"), "US").alias("phone"))


# --- columns that are not text ----------------------------------------------


@query
def infer_orders(spark, folder):
    return Cleaner([InferTypes()]).run(keyed(spark, folder, "orders", "o_orderkey")).suggestions


def _sizes(spark, folder):
    size = F.when(F.col("p_partkey") % 7 > 0, F.col("p_size")).alias("p_size")
    return load(spark, folder, "part").select(F.col("p_partkey").alias(ROW_ID), size)


@query
def mis_mean_int(spark, folder):
    return shown(data(_sizes(spark, folder), MissingValues(["p_size"], "mean")).withColumn("p_size", F.round("p_size", 9)), "p_size")


@query
def mis_median_int(spark, folder):
    return shown(data(_sizes(spark, folder), MissingValues(["p_size"], "median")), "p_size")


@query
def val_required_typed(spark, folder):
    day = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate")).alias("o_orderdate")
    table = load(spark, folder, "orders").select(F.col("o_orderkey").alias(ROW_ID), day)
    return Cleaner([Required(["o_orderdate"])]).run(table).issues.select("row_id", "column", "rule", "value", "message")


# --- whole plans and audit -------------------------------------------------


def _plan(spark, folder):
    return Cleaner(steps_from_options(PLAN)).run(dirty(spark, folder))


@query
def clean_rows(spark, folder):
    return shown(_plan(spark, folder).numbered, "name", "email", "signup_date", "amount", "status", "phone")


@query
def clean_preview(spark, folder):
    return shown(_plan(spark, folder).preview(20), "name", "email", "signup_date", "amount", "status", "phone")


@query
def aud_changes(spark, folder):
    return _plan(spark, folder).changes


@query
def aud_issues(spark, folder):
    return _plan(spark, folder).issues


@query
def aud_dups(spark, folder):
    return long_form(_plan(spark, folder).duplicates).select("step", "operation", "kept_row", "matched_row", "score", "reason")


@query
def aud_summary(spark, folder):
    return _plan(spark, folder).summary


@query
def aud_totals(spark, folder):
    return _plan(spark, folder).report


@query
def aud_roundtrip(spark, folder):
    """The summary of a written report, recomputed from its ledger tables."""
    tables = read_report(spark, write_report(_plan(spark, folder), scratch_path(spark, "report")))
    steps = tables["summary"].select("step", "operation")
    counts = {"changes": F.count(F.lit(1)), "issues": F.count(F.lit(1)), "duplicates": F.count_distinct("kept_row")}
    per_step = [tables[kind].groupBy("step").agg(count.alias(kind)) for kind, count in counts.items()]
    for counts in per_step:
        steps = steps.join(counts, "step", "left")
    return steps.na.fill(0, ["changes", "issues", "duplicates"])


@query
def rpt_sections(spark, folder):
    """Entries per section of the JSON report; of duplicates, the matched rows."""
    matched = F.from_json("json", "array<struct<matched_rows: array<bigint>>>")
    matched = F.aggregate(matched, F.lit(0), lambda n, g: n + F.size(g["matched_rows"]))
    entries = F.when(F.col("section") == "duplicates", matched).otherwise(F.json_array_length("json"))
    lines = report_lines(_plan(spark, folder)).where("section not in ('report', 'operation')")
    return lines.groupBy("step", "section").agg(F.sum(entries).cast("bigint").alias("entries"))


class DropDrafts(Step):
    """A user-written step: drops rows of one status."""

    name = "drop-drafts"

    def apply(self, df, step):
        draft = F.lower("status") == "draft"
        return Outcome(data=df.where(~draft), removed=df.where(draft).select(ROW_ID))


@query
def custom_step(spark, folder):
    return Cleaner([DropDrafts(), Required(["name"])]).run(dirty(spark, folder)).summary


# --- sources and sinks -----------------------------------------------------


def _round_trip(spark, folder, fmt, **options):
    broken = dirty(spark, folder).drop(ROW_ID).withColumn("name", F.concat("name", F.lit("\nsecond, \"line\"")))
    path = write_table(broken, scratch_path(spark, "io"), fmt)
    return read_table(spark, path, fmt, **options)


@query
def io_csv(spark, folder):
    return _round_trip(spark, folder, "csv")


@query
def io_csv_by_name(spark, folder):
    """Files of one folder that order their columns differently, with line breaks in cells."""
    broken = dirty(spark, folder).withColumn("name", F.concat("name", F.lit("\nsecond, \"line\"")))
    path = scratch_path(spark, "io")
    write_table(broken.where(f"{ROW_ID} % 3 = 0").drop(ROW_ID), path, "csv")
    write_table(broken.where(f"{ROW_ID} % 3 > 0").select(*reversed(broken.drop(ROW_ID).columns)), path, "csv", mode="append")
    return read_table(spark, path, "csv")


@query
def io_json(spark, folder):
    return _round_trip(spark, folder, "json")


@query
def io_json_array(spark, folder):
    """Files that hold an array each, with brackets, quotes and line breaks in strings."""
    broken = dirty(spark, folder).withColumn("name", F.concat("name", F.lit('\n"}, ] {\\" [')))
    place = Window.partitionBy("part").orderBy(ROW_ID)
    rows = broken.withColumn("part", F.floor(F.col(ROW_ID) / 5000)).select(
        "part", F.concat(
            F.when(F.lag(ROW_ID).over(place).isNull(), "[").otherwise(","),
            F.to_json(F.struct(*broken.drop(ROW_ID).columns), {"ignoreNullFields": "false"}),
            F.when(F.lead(ROW_ID).over(place).isNull(), "]").otherwise(""),
        ).alias("value")
    )
    path = scratch_path(spark, "io")
    rows.write.partitionBy("part").text(path)
    return read_table(spark, path, "json")


@query
def io_convert(spark, folder):
    """JSON to CSV and back into a table, formats told by the suffix."""
    source = write_table(dirty(spark, folder).drop(ROW_ID), f"{scratch_path(spark, 'io')}.json")
    return read_table(spark, convert(spark, source, f"{scratch_path(spark, 'io')}.csv"))


@query
def src_detect(spark, folder):
    return read_table(spark, f"{folder}/nation.parquet")


@query
def src_rowid(spark, folder):
    return read_table(spark, f"{folder}/orders.parquet", row_id=True).select(
        F.col(ROW_ID).alias("row_id"), "o_orderkey", "o_totalprice"
    )


# --- streams ---------------------------------------------------------------


def _stream(spark, folder, name):
    schema = load(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _drain(writer, spark):
    done = writer.option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start()
    done.awaitTermination()


@query
def str_rowwise(spark, folder):
    plan = Cleaner([NormalizeText(["o_orderpriority"], "title"), AllowedValues(["o_orderstatus"], ["f", "o"])])
    out = scratch_path(spark, "clean-stream")
    _drain(clean_stream(_stream(spark, folder, "orders"), plan, out, key="o_orderkey"), spark)
    issues = spark.read.parquet(f"{out}/issues").select("row_id", "column", "value", "message")
    cleaned = spark.read.parquet(f"{out}/data")
    return issues.unionByName(cleaned.select(
        F.col("o_orderkey").alias("row_id"), F.lit("o_orderpriority").alias("column"), F.col("o_orderpriority").alias("value"),
        F.lit(None).cast("string").alias("message"),
    ))


@query
def str_dedup(spark, folder):
    events = _stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch_path(spark, "dedup-stream")
    kept = dedup_stream(events, ["user_id", "event_type"], "ts", "1 hour").select("user_id", "event_type")
    _drain(kept.writeStream.format("parquet").option("path", out), spark)
    return spark.read.schema("user_id bigint, event_type string").parquet(out)


@query
def str_rates(spark, folder):
    rules = [AllowedValues(["event_type"], ["click", "view"]), InRange(["value"], 1, 50)]
    events = _stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch_path(spark, "rates-stream")
    rates = issue_rates(events, rules, "ts", key="event_id", delay="1 hour")
    _drain(rates.writeStream.format("parquet").outputMode("append").option("path", out), spark)
    rates = spark.read.schema("window_start timestamp, rule string, issues bigint").parquet(out)
    return rates.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))
