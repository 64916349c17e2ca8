"""Views of the account-intelligence tables over the driver's tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NOW = "2024-01-31 00:00:00"

VIEWS = {
    "company": """
select c_custkey as company_id, c_name as name, concat(lower(replace(c_name,'#','-')),'.example') as domain,
       upper(substr(n_name,1,2)) as country_code, lower(c_mktsegment) as industry_id,
       case when c_acctbal < 0 then null else cast(floor(c_acctbal*10) as bigint) end as employees,
       cast(c_custkey % 10 as int) < 9 as is_tracked
from customer join nation on c_nationkey = n_nationkey""",
    "question": """
select distinct cast(l_linenumber + 0 as bigint) as question_id, concat('q', cast(l_linenumber as string)) as question_key,
       case when l_linenumber >= 6 then 'negative' else 'positive' end as polarity,
       case l_linenumber % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as weight,
       l_linenumber <> 5 as is_active
from lineitem""",
    "signal": """
select event_id as signal_id, user_id as company_id, event_id % 2 as service_id, 1 + event_id % 7 as question_id,
       case event_type when 'signup' then 'expansion' when 'error' then 'distress' when 'click' then 'ai_automation'
                       when 'view' then 'hiring' else 'tech_stack' end as category,
       case when value < 30 then 'weak' when value < 70 then 'moderate' else 'strong' end as strength,
       0.4 + (event_id % 60) / 100.0 as confidence,
       case event_id % 5 when 0 then 'news' when 1 then 'jobs' when 2 then 'website' when 3 then 'report' else 'registry' end as source_type,
       case when event_id % 6 = 0 then null else cast(ts as date) end as event_date,
       ts as detected_at, concat('e', cast(event_id % 997 as string)) as evidence_key,
       case when event_id % 13 = 0 then 'superseded' when event_id % 17 = 0 then 'rejected_by_user' else 'active' end as status,
       concat('Quote ', cast(event_id % 211 as string), case when event_id % 9 = 0 then ' Stellenabbau' else '' end) as quote,
       event_id % 400 as document_id
from events""",
    "document": """
select doc_id, doc_id % 150 as company_id,
       case doc_id % 5 when 0 then 'news' when 1 then 'jobs' when 2 then 'website' when 3 then 'report' else 'registry' end as source_type,
       source as source_name, lang as language, text, n_chars,
       case when doc_id % 7 = 0 then null else cast('2023-12-20' as date) + cast(doc_id % 40 as int) end as published_on
from documents""",
    "feedback": """
select doc_id % 11 as user_id, case when doc_id % 10 = 3 then 'lead' else 'signal' end as target_type, doc_id % 500 as target_id,
       case when doc_id % 10 = 3 then case when quality = 1 then 'good_fit' else 'bad_fit' end
            when quality = 1 then 'correct' else 'incorrect' end as verdict, doc_id as version
from labels""",
    "llm_call": """
select o_orderkey as call_id, lower(substr(o_orderpriority, 3)) as model, case o_orderstatus when 'F' then 'ok' when 'O' then 'error' else 'rate_limited' end as status,
       o_orderkey % 4 = 0 as cache_hit, o_custkey % 900 as input_tokens, o_custkey % 300 as output_tokens,
       o_orderdate + interval 1 hour * cast(o_orderkey % 24 as int) as created_at
from orders""",
    "score": """
select o_orderkey as score_id, o_custkey as company_id, o_orderkey % 2 as service_id, o_orderdate as computed_at,
       floor(o_totalprice / 50) % 101 as priority, floor(o_totalprice / 70) % 101 as intent, floor(o_totalprice / 90) % 101 as fit
from orders""",
    "run_event": """
select conv_id * 100 + turn as id, conv_id as run_id, conv_id % 50 as company_id, role as stage,
       case when turn % 5 = 4 then 'failed' when turn % 3 = 2 then 'paused' else 'done' end as status, length(text) as n_chars
from conversations""",
    "rejected": """
select l_orderkey as rejected_id, case l_linenumber when 1 then 'quote_not_found' when 2 then 'wrong_subject' when 3 then 'stale'
       when 4 then 'below_confidence' else 'no_evidence_for_yes' end as reason from lineitem where l_linenumber <= 5""",
    "rule": """
select r_regionkey as rule_id, r_regionkey % 2 as service_id, case r_regionkey when 0 then 'country' when 1 then 'employees_lt' when 2 then 'employees_gt' when 3 then 'industry' else 'question' end as kind,
       case r_regionkey when 0 then 'exclude' when 1 then 'cap' when 2 then 'flag' when 3 then 'cap' else 'flag' end as action,
       case r_regionkey when 1 then 40.0 when 3 then 55.0 else null end as cap_value, r_name as name
from region""",
    "alert_rule": """
select s_suppkey as rule_id, s_suppkey % 7 as user_id, s_nationkey as country_nation, s_suppkey % 3 <> 0 as is_active,
       case s_suppkey % 3 when 1 then 'weak' when 2 then 'strong' else 'moderate' end as min_strength,
       case when s_suppkey % 4 = 0 then null else s_suppkey * 3 % 150 end as only_company, s_name as name
from supplier""",
}

#: The driver's tables that each view reads.
TABLES = {
    "company": ["customer", "nation"], "question": ["lineitem"], "signal": ["events"], "document": ["documents"], "feedback": ["labels"], "llm_call": ["orders"],
    "score": ["orders"], "run_event": ["conversations"], "rejected": ["lineitem"], "rule": ["region"], "alert_rule": ["supplier"],
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views above. Numbers with a point are doubles, as DuckDB makes them where they meet a quotient, so that equal values are equal to the last bit."""
    sql = re.sub(r"\b\d+\.\d+\b", r"\g<0>D", VIEWS[name])
    for t in TABLES[name]:
        sql = _placeholder(sql, t)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]})


def _placeholder(sql: str, table: str) -> str:
    for word in ("from ", "join "):
        sql = sql.replace(f"{word}{table}", f"{word}{{{table}}}")
    return sql


def with_views(sql: str, *names: str) -> str:
    """SQL for DuckDB with the views as common table expressions."""
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in names) + ("," if sql.lstrip().startswith("+") else "\n") + sql.lstrip().lstrip("+")
