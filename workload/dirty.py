"""A messy customer table derived from ``customer``; the text runs in Spark and DuckDB."""

DIRTY_SQL = """
select c_custkey as row_id,
 case when c_custkey % 11 = 0 then null when c_custkey % 13 = 0 then '   '
      when c_custkey % 3 = 0 then concat('  ', upper(c_name), '   o''neil-x ') else lower(c_name) end as name,
 case when c_custkey % 17 = 0 then null when c_custkey % 19 = 0 then 'bad-email'
      when c_custkey % 5 = 0 then concat(' USER', cast(c_custkey % 700 as varchar(20)), '@Example.COM ')
      else concat('user', cast(c_custkey % 700 as varchar(20)), '@example.com') end as email,
 case when c_custkey % 23 = 0 then 'broken' when c_custkey % 29 = 0 then ''
      when c_custkey % 2 = 0 then concat(lpad(cast(1 + c_custkey % 12 as varchar(2)),2,'0'),'/',lpad(cast(1 + c_custkey % 31 as varchar(2)),2,'0'),'/2026')
      else concat('2026-',lpad(cast(1 + c_custkey % 12 as varchar(2)),2,'0'),'-',lpad(cast(1 + c_custkey % 31 as varchar(2)),2,'0')) end as signup_date,
 case when c_custkey % 31 = 0 then null when c_custkey % 37 = 0 then 'n.a.' else cast(cast(floor(c_acctbal) as bigint) as varchar(20)) end as amount,
 case when c_custkey % 41 = 0 then 'draft' when c_custkey % 2 = 0 then 'Active' else 'blocked' end as status,
 case when c_custkey % 43 = 0 then '123' when c_custkey % 3 = 0 then concat('(415) 555-', lpad(cast(c_custkey % 10000 as varchar(4)),4,'0'))
      else concat('+1 212 555 ', lpad(cast(c_custkey % 10000 as varchar(4)),4,'0')) end as phone
from customer
"""

COLUMNS = ("name", "email", "signup_date", "amount", "status", "phone")

# Numeric variant for mean and median: balances with gaps, as text.
SCORES_SQL = """
select c_custkey as row_id,
 case when c_custkey % 7 = 0 then null when c_custkey % 9 = 0 then '  '
      else cast(cast(floor(c_acctbal) as bigint) as varchar(20)) end as score
from customer
"""
