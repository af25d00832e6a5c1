"""DuckDB statements that compute what the registered queries must return."""

from __future__ import annotations

from .dirty import COLUMNS, DIRTY_SQL, SCORES_SQL

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
EMAIL = r"[^@\s]+@[^@\s]+\.[^@\s]+"
NUMBER = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"


def ws(c):
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def upper(c, sharp_s="SS"):
    # the full upper case of a sharp s is two letters
    return f"replace(upper({c}), 'ẞ', '{sharp_s}')"


def title(c):
    runs = rf"regexp_extract_all({c}, '\p{{L}}+|\P{{L}}+')"
    return f"array_to_string(list_transform({runs}, lambda x: {upper('x[1]', 'Ss')} || lower(x[2:])), '')"


def blank(c):
    return f"({c} is null or {ws(c)} = '')"


def email(c):
    return f"nullif(lower(trim({c})), '')"


def bad_email(c):
    return f"({c} is not null and not regexp_full_match({c}, '{EMAIL}'))"


def day(c):
    return f"coalesce(try_strptime(trim({c}), '%m/%d/%Y'), try_strptime(trim({c}), '%Y-%m-%d'))"


def iso(c):
    return f"coalesce(strftime({day(c)}, '%Y-%m-%d'), nullif(trim({c}), ''))"


def e164(c):
    digits = f"regexp_replace({c}, '[^0-9]', '', 'g')"
    return (
        f"case when regexp_full_match({digits}, '1?[2-9][0-9]{{2}}[2-9][0-9]{{6}}') "
        f"then '+1' || right({digits}, 10) end"
    )


def phone(c):
    return f"coalesce({e164(c)}, nullif(trim({c}), ''))"


def number(c):
    return f"case when regexp_full_match(trim({c}), '{NUMBER}') then cast(trim({c}) as double) end"


def token_sort(c):
    return f"array_to_string(list_sort(list_filter(string_split({c}, ' '), lambda x: x <> '')), ' ')"


def lcs(a, b):
    """Length of the longest common subsequence by list operations."""
    return f"""coalesce(list_last(list_reduce(
      list_transform(range(1, len({a}) + 1), lambda i: list_transform(range(1, len({b}) + 1),
        lambda j: cast(case when {a}[i] = {b}[j] then 1 else 0 end as int))),
      lambda row, mask: list_transform(range(1, len(mask) + 1), lambda j: list_max(list_transform(range(1, j + 1),
        lambda k: cast(case when mask[k] = 1 then coalesce(row[k-1], 0) + 1 else row[k] end as int)))),
      list_transform(range(0, len({b})), lambda x: cast(0 as int)))), 0)"""


def ratio(a, b):
    return (
        f"(case when len({a}) + len({b}) = 0 then 100.0 else "
        f"(1.0 - cast(len({a}) + len({b}) - 2 * {lcs(a, b)} as double) / (len({a}) + len({b}))) * 100.0 end)"
    )


def over_dirty(body, more=""):
    return f"with dirty as ({DIRTY_SQL}){more} {body}"


def change_rows(step, name, column, after, where=None, source="dirty"):
    changed = where or f"{column} is distinct from {after}"
    return (
        f"select {step} as step, '{name}' as operation, row_id, '{column}' as \"column\", {column} as \"before\", "
        f"{after} as \"after\", 'string' as value_type, '{name}' as reason from {source} where {changed}"
    )


def issue_rows(step, name, column, rule, message, where, value=None, source="dirty", kind="string"):
    return (
        f"select {step} as step, '{name}' as operation, row_id, '{column}' as \"column\", '{rule}' as rule, "
        f"{value or column} as value, '{kind}' as value_type, {message} as message from {source} where {where}"
    )


def union(*parts):
    return " union all ".join(parts)


def range_message(c, low, high, low_text, high_text):
    n = number(c)
    return (
        f"case when {n} is null then 'Value is not numeric' when {n} < {low} then 'Value is below minimum {low_text}' "
        f"when {n} > {high} then 'Value is above maximum {high_text}' end"
    )


def type_row(column, override=None):
    if override:
        return (
            f"select '{column}' as \"column\", '{override}' as suggested_type, cast(1 as double) as confidence, "
            "'explicit override' as reason"
        )
    flags = "('true', 'false', 'yes', 'no', '1', '0')"
    days = f"coalesce({day('v')}, try_strptime(trim(v), '%d/%m/%Y'))"
    return f"""select '{column}' as "column",
      case when n = 0 then 'empty' when best < 0.6 then 'text' when b = best then 'boolean' when m = best then 'number' else 'date' end as suggested_type,
      case when n = 0 or best < 0.6 then 1.0 else round(best, 2) end as confidence,
      case when n = 0 then 'all values are blank' else n || ' non-blank values sampled' end as reason
      from (select *, greatest(b, m, d) as best from (
        select count(*) as n,
          count(*) filter (where lower(trim(v)) in {flags}) / nullif(cast(count(*) as double), 0) as b,
          count(*) filter (where ({number('v')}) is not null) / nullif(cast(count(*) as double), 0) as m,
          count(*) filter (where {days} is not null) / nullif(cast(count(*) as double), 0) as d
        from (select {column} as v from dirty where not {blank(column)})))"""


ORACLES: dict[str, str] = {}

# --- profiling -------------------------------------------------------------

ORACLES["prf_shape"] = over_dirty(
    f"select count(*) as rows, {len(COLUMNS)} as columns, '{','.join(COLUMNS)}' as column_names from dirty"
)
ORACLES["prf_infer"] = over_dirty(union(*[type_row(c) for c in COLUMNS]))
ORACLES["prf_override"] = over_dirty(union(type_row("amount", "text"), type_row("status")))
ORACLES["aud_types"] = over_dirty(
    "select 0 as step, 'type-inference' as operation, * from ("
    + union(type_row("email"), type_row("signup_date")) + ")"
)

# --- normalization ---------------------------------------------------------

for _name, _case in (("nrm_ws", "{}"), ("nrm_lower", "lower({})"), ("nrm_upper", upper("{}"))):
    ORACLES[_name] = over_dirty(f"select row_id, {_case.format(ws('name'))} as name from dirty")
    ORACLES[f"{_name}_documents"] = f"select doc_id as row_id, {_case.format(ws('text'))} as text from documents"
ORACLES["nrm_title"] = over_dirty(f"select row_id, {title(ws('name'))} as name from dirty")
ORACLES["nrm_title_documents"] = f"select doc_id as row_id, {title(ws('text'))} as text from documents"
ORACLES["nrm_email"] = over_dirty(f"select row_id, {email('email')} as email from dirty")
ORACLES["nrm_date"] = over_dirty(f"select row_id, {iso('signup_date')} as signup_date from dirty")
ORACLES["nrm_phone"] = over_dirty(f"select row_id, {phone('phone')} as phone from dirty")

ORACLES["chg_text"] = over_dirty(
    union(*[change_rows(0, "text-normalization", c, title(ws(c))) for c in ("name", "status")])
)
ORACLES["chg_email"] = over_dirty(change_rows(0, "email-normalization", "email", email("email")))
ORACLES["chg_date"] = over_dirty(change_rows(0, "date-normalization", "signup_date", iso("signup_date")))
ORACLES["chg_phone"] = over_dirty(change_rows(0, "phone-normalization", "phone", phone("phone")))
ORACLES["chg_documents"] = union(*[
    f"select doc_id as row_id, '{c}' as \"column\", md5({c}) as \"before\", md5({ws(c)}) as \"after\" "
    f"from documents where {c} is distinct from {ws(c)}"
    for c in ("text", "source")
])


def normalization_issues(first):
    e, d, p = email("email"), iso("signup_date"), phone("phone")
    return union(
        issue_rows(first, "email-normalization", "email", "valid_email", "'Email is invalid'", bad_email(e), e),
        issue_rows(first + 1, "date-normalization", "signup_date", "parseable_date", "'Date could not be parsed'",
                   f"{d} is not null and {day('signup_date')} is null", d),
        issue_rows(first + 2, "phone-normalization", "phone", "valid_phone", "'Phone number is invalid'",
                   f"{p} is not null and {e164('phone')} is null", p),
    )


ORACLES["iss_nrm"] = over_dirty(normalization_issues(0))

# --- missing values --------------------------------------------------------

ORACLES["mis_keep"] = over_dirty("select row_id, name from dirty")
ORACLES["mis_drop"] = over_dirty(
    f"select row_id, name, email from dirty where not {blank('name')} and not {blank('email')}"
)
ORACLES["mis_fill"] = over_dirty(
    union(*[change_rows(0, "missing-value-handling", c, "'1'", blank(c)) for c in ("name", "amount", "signup_date")])
)


def centre(fn):
    return (
        f"with scores as ({SCORES_SQL}) select row_id, round(case when {blank('score')} then (select {fn}(cast(trim(score) "
        f"as double)) from scores where not {blank('score')}) else cast(score as double) end, 4) as score from scores"
    )


ORACLES["mis_mean"] = centre("avg")
ORACLES["mis_median"] = centre("median")


def mode(c):
    return (
        f"(select {c} from dirty where not {blank(c)} group by {c} order by count(*) desc, min(row_id) limit 1)"
    )


ORACLES["mis_mode"] = over_dirty(
    "select row_id, " + ", ".join(f"case when {blank(c)} then {mode(c)} else {c} end as {c}" for c in ("email", "name"))
    + " from dirty"
)

# --- validation ------------------------------------------------------------


def required(step):
    return union(*[
        issue_rows(step, "required-value-validation", c, "required", "'Required value is missing'", blank(c))
        for c in ("name", "email", "amount", "signup_date")
    ])


_positive = f"case when {number('amount')} is null then 'Value is not numeric' when {number('amount')} <= 0 then 'Value must be positive' end"
_allowed = f"not {blank('status')} and lower(status) not in ('active', 'blocked')"
_range = range_message("amount", 0, 5000, "0", "5000")

ORACLES["val_required"] = over_dirty(required(0))
ORACLES["val_range"] = over_dirty(
    issue_rows(0, "range-validation", "amount", "range", _range, f"not {blank('amount')} and ({_range}) is not null")
)
ORACLES["val_positive"] = over_dirty(
    issue_rows(0, "positive-number-validation", "amount", "positive_number", _positive,
               f"not {blank('amount')} and ({_positive}) is not null")
)
ORACLES["val_allowed"] = over_dirty(
    issue_rows(0, "allowed-values-validation", "status", "allowed_values", "'Value is not in allowed set'", _allowed)
)
ORACLES["val_email"] = over_dirty(
    issue_rows(0, "email-validation", "email", "valid_email", "'Email is invalid'",
               f"not {blank('email')} and {bad_email(email('email'))}")
)
ORACLES["val_date"] = over_dirty(
    issue_rows(0, "date-parseability-validation", "signup_date", "parseable_date", "'Date could not be parsed'",
               f"not {blank('signup_date')} and {day('signup_date')} is null")
)
ORACLES["val_range_balances"] = issue_rows(
    0, "range-validation", "c_acctbal", "range",
    "case when c_acctbal < 0 then 'Value is below minimum 0' else 'Value is above maximum 9000.5' end",
    "c_acctbal < 0 or c_acctbal > 9000.5", "cast(c_acctbal as varchar)",
    "(select *, c_custkey as row_id from customer)", "double",
)
ORACLES["val_allowed_orders"] = issue_rows(
    0, "allowed-values-validation", "o_orderpriority", "allowed_values", "'Value is not in allowed set'",
    "lower(o_orderpriority) not in ('1-urgent', '2-high', '5-low')", None,
    "(select *, o_orderkey as row_id from orders)",
)
ORACLES["val_lineitem_rates"] = "select \"column\", rule, message, count(*) as issues from (" + union(
    *[
        f"select '{c}' as \"column\", 'range' as rule, case when {c} < 0.02 then 'Value is below minimum 0.02' "
        f"when {c} > 40 then 'Value is above maximum 40' end as message from lineitem"
        for c in ("l_quantity", "l_discount")
    ],
    "select 'l_tax' as \"column\", 'positive_number' as rule, case when l_tax <= 0 then 'Value must be positive' end "
    "as message from lineitem",
) + ") where message is not null group by all"

# --- scalar functions ------------------------------------------------------

ORACLES["fn_blank"] = over_dirty(f"select row_id, {blank('name')} as blank from dirty")
ORACLES["fn_number"] = over_dirty(f"select row_id, {number('amount')} as number from dirty")
ORACLES["fn_date"] = over_dirty(f"select row_id, strftime({day('signup_date')}, '%Y-%m-%d') as d from dirty")
ORACLES["fn_bool"] = (
    "select doc_id as row_id, coalesce(lower(trim(case when toxic = 1 then ' YES ' else cast(quality as varchar) end)) "
    "in ('true', 'false', 'yes', 'no', '1', '0'), false) as text_flag, false as number_flag from labels"
)
ORACLES["fn_email"] = over_dirty(f"select row_id, regexp_full_match(lower(trim(email)), '{EMAIL}') as ok from dirty")
ORACLES["fn_exactkey"] = over_dirty(f"select row_id, lower({ws('name')}) as key from dirty")
_comp = "trim(coalesce(lower({}), '') || ' ' || coalesce(lower({}), ''))".format(ws("name"), ws("email"))
ORACLES["fn_comptext"] = over_dirty(f"select row_id, {_comp} as text from dirty")
ORACLES["fn_tokensort"] = f"""with t as (select p_partkey, {token_sort('lower(p_name)')} as a,
  {token_sort("lower(p_type || ' ' || p_brand)")} as b from part)
  select p_partkey, round({ratio('a', 'b')}, 6) as score from t"""
ORACLES["fn_ratio"] = over_dirty(
    f"select round(count(*) filter (where ({number('amount')}) is not null) / "
    f"cast(count(*) filter (where not {blank('amount')}) as double), 8) as share from dirty"
)

# --- deduplication ---------------------------------------------------------

_EMAIL_KEY = f"lower({ws('email')})"
_FIRST = "row_number() over (partition by {} order by row_id) = 1"

ORACLES["dup_exact"] = over_dirty(f"select row_id, email, name from dirty qualify {_FIRST.format(_EMAIL_KEY)}")
_GROUPS = (
    "select min(row_id) as kept_row, list_sort(list(row_id))[2:] as matched_rows, cast(100 as double) as score, "
    "'exact duplicate' as reason from {} group by {} having count(*) > 1"
)
_LONG = "select kept_row, unnest(matched_rows) as matched_row, score, reason from ({})"
ORACLES["dup_exact_groups"] = over_dirty(_LONG.format(_GROUPS.format("dirty", _EMAIL_KEY)))
ORACLES["dup_exact_all_columns"] = (
    "select row_id, p_name, p_brand, p_type from (select *, p_partkey as row_id from part) qualify "
    + _FIRST.format("lower(p_name), lower(p_brand), lower(p_type)")
)
ORACLES["dup_exact_documents"] = (
    "select row_id, lang, n_chars from (select *, doc_id as row_id from documents) qualify "
    # a German sharp s and ss are one letter to case folding
    + _FIRST.format(f"replace(lower({ws('text')}), 'ß', 'ss')")
)
ORACLES["dup_exact_orders"] = (
    "select kept_row, unnest(matched_rows) as matched_row, score from ("
    + _GROUPS.format("(select *, o_orderkey as row_id from orders)", "o_custkey, lower(o_orderstatus)") + ")"
)

ORACLES["dup_exact_all_orders"] = (
    "select row_id, o_custkey, o_orderdate, o_totalprice from (select *, o_orderkey as row_id from orders) qualify "
    + _FIRST.format("o_custkey, lower(o_orderstatus), o_totalprice, o_orderdate, lower(o_orderpriority)")
)


def fuzzy(source, text, threshold, before=""):
    """CTEs: r (rows), n (distinct texts), p (verified pairs of first rows).

    Levenshtein never exceeds insertions plus deletions, so it may go first.
    """
    return f"""with recursive {before} r as materialized (select row_id, {text} as t from {source}),
      n as materialized (select t, min(row_id) as id, count(*) as copies, row_number() over (order by min(row_id)) - 1 as pos from r group by t),
      c as materialized (select x.id as a, y.id as b, x.pos as pa, y.pos as pb, x.t as ta, y.t as tb from n x, n y
        where x.id < y.id and levenshtein(x.t, y.t) <= (1 - {threshold} / 100.0) * (len(x.t) + len(y.t)) + 1e-6),
      p as materialized (select * from (select *, {ratio('ta', 'tb')} as score from c) where score >= {threshold}),
      g(i, kept) as (select cast(-1 as bigint), cast([] as bigint[]) union all
        select i + 1, case when exists (select 1 from p where p.pb = i + 1 and list_contains(kept, p.pa))
          then kept else list_append(kept, i + 1) end from g where i + 1 < (select count(*) from n)),
      k as materialized (select n.id, n.t from n where pos in (select unnest(kept) from g where i = (select max(i) from g))),
      l as materialized (select n.t, coalesce(min(p.a), n.id) as leader, coalesce(arg_min(p.score, p.a), 100.0) as score
        from n left join (select * from p where a in (select id from k)) p on p.b = n.id and n.id not in (select id from k) group by n.t, n.id)
      """


_PART = ("(select *, p_partkey as row_id from part)", token_sort("lower(p_name)"), 80)
_CUSTOMER = ("dirty", token_sort(_comp), 97, f"dirty as materialized ({DIRTY_SQL}),")
_REASON = "'fuzzy duplicate above threshold 80' as reason"

ORACLES["dup_pairs"] = fuzzy(*_PART) + "select a, b, round(score, 6) as score from p"
ORACLES["dup_suggest"] = fuzzy(*_PART) + f"""
  select kept_row, matched_row, round(min(score) over (partition by kept_row), 6) as score, {_REASON} from (
    select a as kept_row, b as matched_row, score from p
    union all select n.id, r.row_id, 100.0 from n join r using (t) where r.row_id <> n.id)"""
ORACLES["dup_strict"] = fuzzy(*_PART) + "select p_partkey as row_id, p_name from part where p_partkey in (select id from k)"
ORACLES["dup_strict_groups"] = fuzzy(*_PART) + f"""
  select leader as kept_row, row_id as matched_row, round(min(score) over (partition by leader), 6) as score, {_REASON}
  from r join l using (t) where row_id <> leader"""
ORACLES["dup_pairs_customers"] = fuzzy(*_CUSTOMER) + "select a, b, round(score, 6) as score from p"
ORACLES["dup_pairs_suppliers"] = (
    fuzzy("(select *, s_suppkey as row_id from supplier)", token_sort("lower(s_name)"), 90) + "select a, b, round(score, 6) as score from p"
)
ORACLES["dup_own_key"] = f"""with r as (select {_PART[1]} as t, min(p_partkey) as id from part group by 1)
  select x.id as a, y.id as b, cast(100 as double) as score from r x join r y
  on x.id < y.id and split_part(x.t, ' ', 1) = split_part(y.t, ' ', 1) and len(x.t) = len(y.t)"""
ORACLES["dup_strict_customers"] = fuzzy(*_CUSTOMER) + "select row_id, name, email from dirty where row_id in (select id from k)"

_WORLD = (
    "20 36 40 51 53 56 57 58 60 62 63 66 84 92 93 94 95 98 211 212 213 216 218 220 221 222 223 224 225 226 227 228 229 230 231 "
    "232 233 234 235 236 237 238 239 240 241 242 243 244 245 248 249 250 251 252 253 254 255 256 257 258 260 261 263 264 265"
).split()
ORACLES["nrm_phone_world"] = (
    f"select c_custkey as row_id, case when c_custkey % 5 > 0 then '+' || ({_WORLD!r})[cast(c_custkey % {len(_WORLD)} as int) + 1] "
    "|| '55' || lpad(cast(c_custkey as varchar), 6, '0') end as phone from customer"
)

# --- columns that are not text ----------------------------------------------

ORACLES["infer_orders"] = "select 0 as step, 'type-inference' as operation, c as \"column\", t as suggested_type, 1.0::double as confidence, " \
    "(select count(*) from orders) || ' non-blank values sampled' as reason from (values ('o_custkey', 'number'), ('o_orderstatus', 'text'), " \
    "('o_totalprice', 'number'), ('o_orderdate', 'text'), ('o_orderpriority', 'text')) v(c, t)"
_SIZES = "with s as (select p_partkey as row_id, case when p_partkey % 7 > 0 then p_size end as p_size from part) "
ORACLES["mis_mean_int"] = _SIZES + "select row_id, round(coalesce(p_size::double, (select avg(p_size) from s)), 9) as p_size from s"
ORACLES["mis_median_int"] = _SIZES + "select row_id, coalesce(p_size::double, (select median(p_size) from s)) as p_size from s"
ORACLES["val_required_typed"] = (
    "select o_orderkey as row_id, 'o_orderdate' as \"column\", 'required' as rule, null::varchar as value, "
    "'Required value is missing' as message from orders where o_orderkey % 5 = 0"
)

# --- whole plans and audit -------------------------------------------------
# steps: 0 infer, 1 fill, 2 required, 3 email, 4 date, 5 positive, 6 allowed, 7 text, 8 email, 9 date, 10 phone, 11 exact

_STEPS = (
    "type-inference", "missing-value-handling", "required-value-validation", "email-validation",
    "date-parseability-validation", "positive-number-validation", "allowed-values-validation", "text-normalization",
    "email-normalization", "date-normalization", "phone-normalization", "exact-deduplication",
)
_PLAN = f""", filled as (select * replace (case when {blank('amount')} then '1' else amount end as amount) from dirty),
  final as (select row_id, {title(ws('name'))} as name, {email('email')} as email, {iso('signup_date')} as signup_date,
    amount, {title(ws('status'))} as status, {phone('phone')} as phone from filled qualify {_FIRST.format(_EMAIL_KEY)}),
  changes as ({union(
    change_rows(1, _STEPS[1], 'amount', "'1'", blank('amount')),
    change_rows(7, _STEPS[7], 'name', title(ws('name'))), change_rows(7, _STEPS[7], 'status', title(ws('status'))),
    change_rows(8, _STEPS[8], 'email', email('email')), change_rows(9, _STEPS[9], 'signup_date', iso('signup_date')),
    change_rows(10, _STEPS[10], 'phone', phone('phone')))}),
  issues as ({union(
    *[issue_rows(2, _STEPS[2], c, 'required', "'Required value is missing'", blank(c), source='filled')
      for c in ('name', 'email', 'signup_date', 'amount')],
    issue_rows(3, _STEPS[3], 'email', 'valid_email', "'Email is invalid'",
               f"not {blank('email')} and {bad_email(email('email'))}"),
    issue_rows(4, _STEPS[4], 'signup_date', 'parseable_date', "'Date could not be parsed'",
               f"not {blank('signup_date')} and {day('signup_date')} is null"),
    issue_rows(5, _STEPS[5], 'amount', 'positive_number', _positive,
               f"not {blank('amount')} and ({_positive}) is not null", source='filled'),
    issue_rows(6, _STEPS[6], 'status', 'allowed_values', "'Value is not in allowed set'", _allowed),
    normalization_issues(8))}),
  dups as ({_GROUPS.format('dirty', f"lower(coalesce({email('email')}, ''))")}),
  steps as (select unnest(range(12)) as step, unnest([{', '.join(f"'{s}'" for s in _STEPS)}]) as operation),
  summary as (select cast(step as int) as step, operation,
    case when step = 11 then (select coalesce(sum(len(matched_rows)), 0) from dups) else 0 end::bigint as rows_removed,
    (select count(*) from changes c where c.step = s.step) as cells_changed,
    (select count(*) from issues i where i.step = s.step) as validation_issues,
    case when step = 11 then (select count(*) from dups) else 0 end as duplicate_groups from steps s)"""
_FINAL = "select row_id, name, email, signup_date, amount, status, phone from final"

ORACLES["clean_rows"] = over_dirty(_FINAL, _PLAN)
ORACLES["clean_preview"] = over_dirty(f"{_FINAL} order by row_id limit 20", _PLAN)
ORACLES["aud_changes"] = over_dirty("select * from changes", _PLAN)
ORACLES["aud_issues"] = over_dirty("select * from issues", _PLAN)
ORACLES["aud_dups"] = over_dirty(f"select 11 as step, '{_STEPS[11]}' as operation, * from ({_LONG.format('from dups')})", _PLAN)
ORACLES["aud_summary"] = over_dirty("select * from summary", _PLAN)
ORACLES["aud_totals"] = over_dirty(
    "select (select count(*) from dirty) as rows_before, (select count(*) from final) as rows_after, "
    "sum(rows_removed)::bigint as rows_removed, sum(cells_changed)::bigint as cells_changed, "
    "sum(validation_issues)::bigint as validation_issue_count, sum(duplicate_groups)::bigint as duplicate_group_count from summary",
    _PLAN,
)
ORACLES["aud_roundtrip"] = over_dirty(
    "select step, operation, cells_changed as changes, validation_issues as issues, duplicate_groups as duplicates from summary",
    _PLAN,
)
ORACLES["rpt_sections"] = over_dirty(
    f"""select 0 as step, 'type_suggestions' as section, {len(COLUMNS)}::bigint as entries
      union all select step, 'cell_changes', count(*) from changes group by step
      union all select step, 'issues', count(*) from issues group by step
      union all select 11, 'duplicates', sum(len(matched_rows))::bigint from dups""", _PLAN,
)
ORACLES["custom_step"] = over_dirty(
    f"""select 0 as step, 'drop-drafts' as operation, count(*) filter (where lower(status) = 'draft') as rows_removed,
      0::bigint as cells_changed, 0::bigint as validation_issues, 0::bigint as duplicate_groups from dirty
      union all select 1, 'required-value-validation', 0, 0, count(*) filter (where lower(status) <> 'draft' and {blank('name')}), 0 from dirty"""
)

# --- sources, sinks, streams -----------------------------------------------

_NULLED = ", ".join(f"nullif({c}, '') as {c}" for c in COLUMNS)
_BROKEN = "replace (name || chr(10) || 'second, \"line\"' as name)"
ORACLES["io_csv"] = over_dirty(f"select {_NULLED} from (select * {_BROKEN} from dirty)")
ORACLES["io_csv_by_name"] = ORACLES["io_csv"]
ORACLES["io_json"] = over_dirty(f"select {', '.join(COLUMNS)} from (select * {_BROKEN} from dirty)")
_BRACED = "replace (name || chr(10) || '\"}, ] {\\\" [' as name)"
ORACLES["io_json_array"] = over_dirty(f"select {', '.join(COLUMNS)} from (select * {_BRACED} from dirty)")
ORACLES["io_convert"] = over_dirty(f"select {_NULLED} from dirty")
ORACLES["src_detect"] = "select * from nation"
ORACLES["src_rowid"] = "select row_number() over (order by o_orderkey) - 1 as row_id, o_orderkey, o_totalprice from orders"
ORACLES["str_rowwise"] = (
    "select o_orderkey as row_id, 'o_orderstatus' as \"column\", o_orderstatus as value, "
    "'Value is not in allowed set' as message from orders where lower(o_orderstatus) not in ('f', 'o') "
    f"union all select o_orderkey, 'o_orderpriority', {title(ws('o_orderpriority'))}, null from orders"
)
ORACLES["str_dedup"] = "select distinct user_id, event_type from events"
ORACLES["str_rates"] = """select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as window_start, rule, count(*) as issues from (
  select ts, 'allowed_values' as rule from events where lower(event_type) not in ('click', 'view')
  union all select ts, 'range' from events where value < 1 or value > 50)
  where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from events) - interval 1 hour group by all"""
