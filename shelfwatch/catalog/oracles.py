"""SQL for the same results, written for another engine.

Every text is plain SQL over the given tables. Shared parts are named fragments
that :func:`sql` puts in front of a query as common table expressions.
"""

from __future__ import annotations

import re

from shelfwatch.operators import triage
from shelfwatch.sources import artefacts


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_quote, values)) + "]"


def _any(text: str, words) -> str:
    return "(" + " or ".join(f"contains({text}, {_quote(w)})" for w in words) + ")"


def _category(message: str) -> str:
    low = f"lower({message})"
    return f"""case
        when {message} is null or {message} = '' then 'unknown'
        when {_any(low, triage.LOCK_WORDS)} then 'infrastructure'
        when {_any(low, triage.CONFIG_WORDS)} then 'config_error'
        when contains({low}, 'configured to fail')
          or (contains({low}, 'got') and contains({low}, 'result')) then 'dbt_test_failure'
        when contains({low}, 'test') and contains({low}, 'fail') then 'dbt_test_failure'
        when {_any(low, triage.MISSING_WORDS)} and {_any(low, triage.OBJECT_WORDS)} then 'schema_change'
        when {_any(low, triage.DEPENDENCY_WORDS)} then 'dependency_error'
        when {_any(low, triage.DATA_WORDS)} then 'data_error'
        when {_any(low, triage.COMPILATION_WORDS)} then 'sql_compilation'
        else 'unknown' end"""


def _normal(error_type: str) -> str:
    return (
        f"case {error_type} when 'compilation_error' then 'sql_compilation' "
        f"when 'database_error' then 'data_error' "
        f"when 'test_failure' then 'dbt_test_failure' else {error_type} end"
    )


FACT = (
    "order_id, customer_id, store_id, order_timestamp, order_date, order_status, channel, "
    "country_code, order_revenue, total_quantity"
)
MONEY = "cast(sum(cast({0} as decimal(18,2))) as double)"
FILE_PATTERN = r"\((models[/\\][^)]+)\)"
NODE_PATTERN = r"\b(model|test)\.[\w-]+\.[\w-]+"
SPACE = r"chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)"


def _revenue(orders: str, excluded: bool = True) -> str:
    rule = "and (o.order_date < date '2000-01-01' or o.order_status <> 'confirmed')" if excluded else ""
    return f"""select o.order_id, o.customer_id, o.store_id, o.order_timestamp, o.order_date,
            o.order_status, o.channel, o.country_code,
            {MONEY.format('i.line_amount')} as order_revenue,
            cast(sum(i.quantity) as bigint) as total_quantity
        from {orders} o join stg_order_items i on o.order_id = i.order_id
        where o.order_status in ('completed', 'confirmed', 'shipped') {rule}
        group by all"""


FRAGMENTS = {
    "raw_orders": """select o_orderkey as order_id, o_custkey as customer_id,
            o_orderkey % (select count(*) from supplier) as store_id,
            o_orderdate as order_timestamp, cast(o_orderdate as date) as order_date,
            case when o_orderstatus = 'F' then 'completed' when o_orderstatus = 'O' then 'confirmed'
                 when o_orderpriority in ('1-URGENT', '2-HIGH') then 'shipped'
                 when o_orderpriority = '3-MEDIUM' then 'cancelled' else 'pending' end as order_status,
            case o_orderkey % 3 when 0 then 'web' when 1 then 'store' else 'mobile' end as channel,
            n_name as country_code
        from orders left join nation on o_custkey % 25 = n_nationkey""",
    "stg_orders": "select * from raw_orders",
    "orders_null": """select * replace (case when order_id % 997 = 3 then null else customer_id end as customer_id)
        from stg_orders""",
    "orders_dup": "select * from stg_orders union all select * from stg_orders where order_id % 1250 = 1",
    "orders_channel": """select * replace (case order_id % 1000 when 0 then 'marketplace' when 1 then null
        else channel end as channel) from stg_orders""",
    "stg_order_items": """select l_orderkey * 10 + l_linenumber as order_item_id, l_orderkey as order_id,
            l_partkey as product_id, cast(l_quantity as integer) as quantity,
            floor(l_extendedprice / nullif(l_quantity, 0) * 100 + 0.5) / 100.0::double as unit_price, l_extendedprice as line_amount
        from lineitem""",
    "items_orphan": """select l_orderkey * 10 + l_linenumber as order_item_id, l_orderkey as order_id,
            case when (l_orderkey + l_linenumber) % 500 = 0 then l_partkey + 1000000000 else l_partkey end
                as product_id
        from lineitem""",
    "stg_products": """select p_partkey as product_id, p_name as product_name, p_type as category,
            p_retailprice as unit_price from part""",
    "stg_customers": """select c_custkey as customer_id, concat('first_', c_custkey) as first_name,
            concat('last_', c_custkey) as last_name, concat('user', c_custkey, '@example.com') as email,
            lower(c_mktsegment) as customer_type, n_name as country_code,
            date '1994-01-01' + cast(c_custkey % 400 as integer) as signup_date
        from customer left join nation on c_nationkey = n_nationkey""",
    "stg_stores": """select s_suppkey as store_id, s_name as store_name, concat('city_', s_nationkey) as city,
            n_name as country_code, case when s_suppkey % 2 = 0 then 'store' else 'web' end as store_channel
        from supplier left join nation on s_nationkey = n_nationkey""",
    "stg_payments": """select o_orderkey as payment_id, o_orderkey as order_id,
            case o_orderkey % 3 when 0 then 'card' when 1 then 'paypal' else 'cash' end as payment_method,
            case when o_orderkey % 50 = 0 then 'failed' when o_orderkey % 50 <= 4 then 'pending'
                 else 'paid' end as payment_status,
            o_orderdate + to_hours(cast(o_orderkey % 72 as integer)) as paid_at
        from orders
        where o_orderstatus in ('F', 'O')
           or (o_orderstatus = 'P' and o_orderpriority in ('1-URGENT', '2-HIGH'))""",
    "int_order_revenue": _revenue("stg_orders"),
    "revenue_no_bug": _revenue("stg_orders", excluded=False),
    "revenue_dup": _revenue("orders_dup"),
    "revenue_channel": _revenue("orders_channel"),
    "fct_orders": f"select {FACT} from int_order_revenue",
    "fct_daily_sales": f"""select order_date, count(distinct order_id) as order_count,
            count(distinct customer_id) as active_customers,
            {MONEY.format('order_revenue')} as total_revenue,
            {MONEY.format('order_revenue')} / count(order_revenue) as avg_order_value
        from fct_orders group by order_date""",
    "versions": """select customer_id, first_name, last_name, email, customer_type, country_code,
            signup_date as valid_from, date '9999-12-31' as valid_to, true as is_current
        from stg_customers
        union all
        select customer_id, first_name, last_name, email, customer_type, country_code,
            signup_date + 180, date '9999-12-31', true
        from stg_customers
        where customer_id in (select customer_id from stg_orders where order_date >= date '2001-07-01')""",
    "joined_versions": """select o.*, v.valid_from, v.valid_to
        from int_order_revenue o left join versions v
          on o.customer_id = v.customer_id and o.order_date >= v.valid_from and o.order_date <= v.valid_to""",
    "ranked_versions": """select *, row_number() over (partition by order_id
            order by valid_from desc nulls last, order_timestamp desc nulls last) as version_rank
        from joined_versions""",
    "faulty_volume": """select * from events
        where not (cast(ts as date) = date '2024-01-17' and event_id % 10 >= 3)""",
    "faulty_null": """select * replace (case when cast(ts as date) between date '2024-01-12' and date '2024-01-14'
            and event_id % 3 = 0 then null else user_id end as user_id) from events""",
    "faulty_replay": """select * from events union all select * from events
        where cast(ts as date) = date '2024-01-09' and event_id % 12 = 0""",
    "faulty_share": """select * replace (case when cast(ts as date) between date '2024-01-19' and date '2024-01-21'
            and event_id % 2 = 0 then 'click' else event_type end as event_type) from events""",
    "faulty_missing": """select * from events
        where not (event_type = 'signup' and cast(ts as date) >= date '2024-01-15')""",
    "faulty_outlier": """select * replace (case when cast(ts as date) = date '2024-01-11' and event_id % 10 = 0
            then value * 1000 else value end as value) from events""",
    "faulty_stopped": "select * from events where ts <= timestamp '2024-01-22 14:00:00'",
    "faulty_all": """select * replace (
            case when cast(ts as date) between date '2024-01-12' and date '2024-01-14' and event_id % 3 = 0
                 then null else user_id end as user_id,
            case when cast(ts as date) = date '2024-01-11' and event_id % 10 = 0
                 then value * 1000 else value end as value)
        from (select * from shifted union all select * from shifted
              where cast(ts as date) = date '2024-01-09' and event_id % 12 = 0)
        where not (event_type = 'signup' and cast(ts as date) >= date '2024-01-15')
          and not (cast(ts as date) = date '2024-01-17' and event_id % 10 >= 3)""",
    "shifted": """select * replace (case when cast(ts as date) between date '2024-01-19' and date '2024-01-21'
            and event_id % 2 = 0 then 'click' else event_type end as event_type) from events""",
    "node_results": f"""select event_id as run_id, cast(k as integer) as position, event_id * 3 + k as num,
            {_list(artefacts.NODE_IDS)}[(event_id * 3 + k) % 4 + 1] as unique_id,
            {_list(artefacts.STATES)}[(event_id * 3 + k) % 5 + 1] as status,
            {_list(artefacts.MESSAGES)}[(event_id * 3 + k) // 5 % 10 + 1] as message,
            case event_id % 4 when 1 then 'dbt build --select marts' when 2 then 'Inconnue'
                 when 3 then 'dbt test' else 'dbt build' end as command_executed
        from events cross join range(3) r(k)""",
    "failures": f"""select run_id, command_executed, position,
            string_split(unique_id, '.')[1] as node_type, unique_id,
            string_split(unique_id, '.')[-1] as node_name,
            regexp_extract(message, {_quote(FILE_PATTERN)}, 1) as file_path, message as error_message
        from node_results where status in ('error', 'fail')""",
    "prioritised": """select *, string_split(replace(case when file_path = '' then node_name else file_path end,
                chr(92), '/'), '/')[-1] as shown,
            case when string_split(replace(case when file_path = '' then node_name else file_path end,
                chr(92), '/'), '/')[-1] in ('fct_orders.sql', 'unique_orders') then 0 else 1 end as sort_priority
        from failures""",
    "expected": f"""select event_id as run_id,
            {_list(artefacts.EXPECTED_TYPES)}[event_id * 3 // 5 % 10 % 8 + 1] as error_type from events
        union all
        select event_id, {_quote(artefacts.EXPECTED_TYPES[2])}
        from events where event_id % 5 = 0""",
    "matches": f"""select run_id, cast(sum(seen) as bigint) as observed_failures,
            cast(sum(wanted) as bigint) as expected_failures,
            bool_and(seen = wanted) as classifications_match,
            sum(seen) = sum(wanted) as failure_count_match
        from (select run_id, category, sum(s) as seen, sum(w) as wanted
              from (select run_id, {_category('error_message')} as category, 1 as s, 0 as w from failures
                    union all
                    select run_id, {_normal('error_type')}, 0, 1 from expected)
              group by run_id, category)
        group by run_id""",
    "reports": """select doc_id, text || case doc_id % 5
                when 0 then chr(10) || '  Source data issue: late file'
                when 1 then chr(10) || 'Conclusion:  source-data correction is required'
                when 2 then chr(10) || 'This is not a source data issue: the model is wrong'
                when 3 then chr(10) || 'Conclusion: a bad join. Conclusion: source data issue: none'
                else chr(10) || 'The infrastructure was locked' end
            || case doc_id % 7 when 0 then '' when 1 then chr(10) || 'confidence: 1.2.3'
                when 2 then chr(10) || 'Confidence : 9'
                else chr(10) || 'CONFIDENCE: 0.' || lpad(cast(doc_id % 100 as varchar), 2, '0') end as report
        from documents""",
    "rated": r"""select doc_id, report,
            case when stated is null then 0.5::double else least(greatest(stated, 0.15), 0.95) end as confidence
        from (select doc_id, report, try_cast(nullif(
                regexp_extract(report, '(?i)confidence[:\s]+([0-9.]+)', 1), '') as double) as stated
              from reports)""",
    "logs": """select doc_id, case doc_id % 4 when 0 then ' ' || chr(10) || chr(9) || ' '
                when 1 then 'Failure in model.retail.fct-orders (models/2_marts/fct_orders.sql)' || chr(10) || text
                when 2 then chr(10) || text || chr(10)
                else text || chr(10) || 'Compilation Error in test.retail.unique_orders' || chr(10) end as log_text
        from documents""",
    "named_logs": f"""select doc_id, message, coalesce(
                nullif(regexp_extract(message, {_quote(NODE_PATTERN)}, 0), ''), 'unknown.dbt.failure') as unique_id
        from (select doc_id, coalesce(nullif(trim(log_text, {SPACE}), ''),
                'dbt failed before producing run_results.json') as message from logs)""",
    "nodes": """select 'node.' || c_custkey as unique_id, c_custkey as num, 'n' || c_custkey as name,
            case c_mktsegment when 'BUILDING' then 'test' when 'MACHINERY' then 'source' else 'model' end
                as resource_type, c_acctbal as balance
        from customer""",
    "edges": """select c.unique_id as child, p.unique_id as parent
        from nodes c join nodes p on p.num = c.num // 2 where c.num > 0""",
    "all_edges": """select child, parent from edges
        union all select unique_id, 'node.' || (num + 1000000000) from nodes where num % 10 = 0""",
    "failed_ids": "select unique_id from nodes where balance < -800",
    "near": """select unique_id as origin, unique_id, 0 as distance from failed_ids
        union select near.origin, e.parent, near.distance + 1 from near join all_edges e on e.child = near.unique_id""",
    "up": """select unique_id as origin, unique_id, 0 as distance from failed_ids
        union select up.origin, e.parent, up.distance + 1 from up join edges e on e.child = up.unique_id""",
    "down": """select unique_id as origin, unique_id, 0 as distance from failed_ids
        union select down.origin, e.child, down.distance + 1
        from down join edges e on e.parent = down.unique_id""",
    "upstream": """select unique_id, min(distance) as distance from up group by unique_id
        having min(distance) > 0""",
    "downstream": """select unique_id, min(distance) as distance from down group by unique_id
        having min(distance) > 0""",
}


def sql(body: str, seen: tuple[str, ...] = ()) -> str:
    """Prefix a query with the fragments it mentions, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in FRAGMENTS:
            if name not in ordered and re.search(rf"\b{name}\b(?!\s*\()", text):
                ordered_text = FRAGMENTS[name]
                if ordered_text is not text:
                    visit(ordered_text)
                    if name not in ordered:
                        ordered.append(name)

    visit(body)
    if not ordered:
        return body
    parts = ",\n".join(f"{name} as (\n        {FRAGMENTS[name]}\n    )" for name in ordered)
    return f"with recursive {parts}\n{body}"


_KPIS = f"""select count(distinct order_id) as orders, count(distinct customer_id) as active_customers,
        coalesce({MONEY.format('order_revenue')}, 0.0::double) as revenue,
        coalesce({MONEY.format('order_revenue')} / nullif(count(order_revenue), 0), 0.0::double) as avg_basket"""
_FILTERED = """order_date between date '1996-01-01' and date '1999-12-31'
        and country_code in ('NATION_1', 'NATION_2', 'NATION_3') and channel in ('web', 'store')"""
_PROFILE = """select count(*) as row_count,
        avg(case when customer_id is null then 1.0 else 0.0 end)::double as null_rate,
        count(distinct customer_id) as distinct_count from orders_null"""
_UNIQUE = "select order_id, count(*) as cnt from {0} group by order_id having count(*) > 1"
_NODE = "node_type, unique_id, node_name, file_path, error_message"
_TRIMMED = f"trim(lower(trim(line, {SPACE})), {SPACE})"


def _marked(text: str) -> str:
    return "(" + " or ".join(f"starts_with({text}, {_quote(m)})" for m in triage.SOURCE_DATA_MARKERS) + ")"


def _intent(column: int) -> str:
    cases = " ".join(
        f"when {_any('lower(text)', words)} then {_quote((name, ','.join(tools))[column])}"
        for name, words, tools in triage.INTENTS
    )
    default = (triage.DEFAULT_INTENT[0], ",".join(triage.DEFAULT_INTENT[1]))[column]
    return f"case {cases} else {_quote(default)} end"


_SUITE = {
    "dq_not_null_customer": "select 1 from orders_null where customer_id is null",
    "dq_not_null_customer_window": """select 1 from orders_null where customer_id is null
        and order_date between date '1996-01-01' and date '1998-12-31'""",
    "dq_unique_orders": _UNIQUE.format("(select * from orders_dup where order_date < date '2001-01-01')"),
    "dq_relationships_product": """select 1 from items_orphan i left join stg_products p
        on i.product_id = p.product_id where p.product_id is null""",
    "orphans_in_window": """select 1 from items_orphan i left join stg_products p
        on i.product_id = p.product_id where p.product_id is null and i.order_id in (
            select order_id from stg_orders where order_date between date '1996-01-01' and date '1998-12-31')""",
    "dq_accepted_channel": """select 1 from orders_channel
        where channel not in ('web', 'mobile', 'store') or channel is null""",
    "dq_fact_grain": _UNIQUE.format("(select * from fct_orders union all select * from fct_orders)"),
    "clean_customer": "select 1 from stg_orders where customer_id is null",
    "clean_orders": _UNIQUE.format("stg_orders"),
}

BODIES = {
    "stg_customers": "select * from stg_customers",
    "stg_orders": "select * from stg_orders",
    "stg_order_items": "select * from stg_order_items",
    "stg_products": "select * from stg_products",
    "stg_stores": "select * from stg_stores",
    "stg_payments": "select * from stg_payments",
    "int_orders": """select o.order_id, o.customer_id, c.customer_type as customer_segment, o.order_date,
            o.order_status, o.channel
        from stg_orders o left join stg_customers c on o.customer_id = c.customer_id""",
    "int_order_revenue": "select * from int_order_revenue",
    "int_order_revenue_no_bug": "select * from revenue_no_bug",
    "int_order_revenue_duplicates": "select * from revenue_dup",
    "int_customer_orders": f"""select c.customer_id, count(distinct r.order_id) as order_count,
            coalesce({MONEY.format('r.order_revenue')}, 0.0::double) as lifetime_revenue,
            min(r.order_date) as first_order_date, max(r.order_date) as last_order_date
        from stg_customers c left join int_order_revenue r on c.customer_id = r.customer_id
        group by c.customer_id""",
    "dim_customers": """select customer_id, first_name, last_name, email, country_code, signup_date
        from stg_customers""",
    "dim_products": "select * from stg_products",
    "dim_stores": "select * from stg_stores",
    "fct_orders": "select * from fct_orders",
    "fct_daily_sales": "select * from fct_daily_sales",
    "order_revenue_positive": "select * from int_order_revenue where order_revenue > 0",
    "revenue_expression": """select order_item_id, order_id, line_amount * quantity as line_value
        from stg_order_items""",
    "cast_tolerant": """select order_id, try_cast(case when order_id % 10 = 0 then 'not-a-date'
            else cast(order_date as varchar) end as date) as parsed_date from stg_orders""",
    "mart_write_roundtrip": """select 'dim_customers' as mart, count(*) as row_count from stg_customers
        union all select 'dim_products', count(*) from stg_products
        union all select 'dim_stores', count(*) from stg_stores
        union all select 'fct_orders', count(*) from fct_orders
        union all select 'fct_daily_sales', count(*) from fct_daily_sales""",
    "fct_orders_full_refresh": f"select {FACT} from ranked_versions where version_rank = 1",
    "fct_orders_incremental_merge": f"""select {FACT} from ranked_versions
        where version_rank = 1 and order_date >= date '2001-07-01'
        union all
        select {FACT} from revenue_no_bug where order_id not in (
            select order_id from int_order_revenue where order_date >= date '2001-07-01')""",
    "fct_orders_incremental_guarded": f"""select {FACT} from int_order_revenue
        where order_date >= date '2001-07-01'
        union all
        select {FACT} from revenue_no_bug where order_id not in (
            select order_id from int_order_revenue where order_date >= date '2001-07-01')""",
    "fact_grain_regression": "select * from fct_orders union all select * from fct_orders",
    "rows_as_json": """select '{"order_id":' || order_id
            || ',"customer_id":' || coalesce(cast(customer_id as varchar), 'null')
            || ',"order_status":"' || order_status || '","order_date":"'
            || strftime(cast(order_date as timestamp), '%Y-%m-%dT%H:%M:%S.%g')
            || '","order_timestamp":"' || strftime(order_timestamp, '%Y-%m-%dT%H:%M:%S.%g') || '"}' as row_json
        from orders_null""",
    "dim_customers_scd2": "select * from versions",
    "scd2_overlaps": """select * from (
            select customer_id, valid_from, max(valid_to) as valid_to, count(*) as version_count,
                lead(valid_from) over (partition by customer_id order by valid_from) as next_valid_from
            from versions group by customer_id, valid_from)
        where version_count > 1 or next_valid_from <= valid_to""",
    "scd2_closed": """select customer_id, first_name, last_name, email, customer_type, country_code, valid_from,
            least(valid_to, coalesce(next_from - 1, valid_to)) as valid_to, next_from is null as is_current
        from (select *, lead(valid_from) over (partition by customer_id order by valid_from) as next_from
              from versions)""",
    "orders_temporal_join": """select order_id, customer_id, order_date, order_revenue, valid_from, valid_to
        from joined_versions""",
    "merge_duplicate_guard": """select count(*) as duplicate_order_count from (
            select order_id from joined_versions where order_date >= date '2001-07-01'
            group by order_id having count(*) > 1)""",
    "kpis": f"{_KPIS} from fct_orders",
    "kpis_filtered": f"{_KPIS} from fct_orders where {_FILTERED}",
    "kpis_empty_range": f"""{_KPIS} from fct_orders
        where order_date between date '1980-01-01' and date '1980-12-31'""",
    "kpis_unfiltered_nulls": f"""{_KPIS}, 'none' as channel_list from revenue_channel
        union all {_KPIS}, 'all' from revenue_channel
        where channel in ('web', 'mobile', 'store', 'marketplace')""",
    "daily_trends": f"""select order_date, count(distinct order_id) as orders,
            {MONEY.format('order_revenue')} as revenue
        from fct_orders where {_FILTERED} group by order_date order by order_date""",
    "by_country": f"""select country_code, {MONEY.format('order_revenue')} as revenue, count(*) as orders
        from fct_orders group by country_code order by revenue desc""",
    "by_channel": f"""select channel, {MONEY.format('order_revenue')} as revenue, count(*) as orders
        from fct_orders where {_FILTERED} group by channel order by revenue desc""",
    "top_products": f"""select p.product_name, p.category, {MONEY.format('i.line_amount')} as revenue,
            cast(sum(i.quantity) as bigint) as units
        from fct_orders o join stg_order_items i on o.order_id = i.order_id
        join stg_products p on i.product_id = p.product_id
        group by p.product_name, p.category
        order by revenue desc nulls last, p.product_name, p.category limit 15""",
    "top_stores": f"""select s.store_name, s.country_code, {MONEY.format('o.order_revenue')} as revenue,
            count(*) as orders
        from fct_orders o join stg_stores s on o.store_id = s.store_id
        group by s.store_name, s.country_code
        order by revenue desc nulls last, s.store_name, s.country_code limit 10""",
    "filter_bounds": """select min(order_date) as min_date, max(order_date) as max_date,
            (select max(order_date) from fct_daily_sales) as data_refresh_date from fct_orders""",
    "filter_countries": "select distinct country_code from fct_orders order by 1",
    "filter_channels": "select distinct channel from fct_orders order by 1",
    "table_profile": _PROFILE,
    "table_profile_day": f"{_PROFILE} where order_date = date '1997-05-28'",
    "metric_history_rows": """select order_date as metric_date, count(*) as metric_value
        from stg_orders group by order_date order by 1 desc limit 14""",
    "metric_history_revenue": """select order_date as metric_date, total_revenue as metric_value
        from fct_daily_sales order by 1 desc limit 14""",
    "metric_history_total": "select count(*) as metric_value from stg_orders",
    "freshness": "select max(order_timestamp) as last_seen from stg_orders",
    "table_schema": """select cast(1 as integer) as position, 'order_id' as column_name, 'bigint' as column_type,
            count(order_id) as value_count from orders_null
        union all select 2, 'customer_id', 'bigint', count(customer_id) from orders_null
        union all select 3, 'store_id', 'bigint', count(store_id) from orders_null
        union all select 4, 'order_timestamp', 'timestamp_ntz', count(order_timestamp) from orders_null
        union all select 5, 'order_date', 'date', count(order_date) from orders_null
        union all select 6, 'order_status', 'string', count(order_status) from orders_null
        union all select 7, 'channel', 'string', count(channel) from orders_null
        union all select 8, 'country_code', 'string', count(country_code) from orders_null""",
    "adhoc_capped": "select order_id, order_date, order_revenue from fct_orders order by order_id limit 100",
    "query_log_readonly": rf"""select event_id, statement,
            regexp_matches(statement, '(?i)^\s*(with|select)\b') and not regexp_matches(statement,
            '(?i)\b(insert|update|delete|drop|create|attach|copy|install)\b') as allowed
        from (select event_id, replace({_list(artefacts.STATEMENTS)}[event_id % 6 + 1], '{{}}',
              cast(event_id as varchar)) as statement from events)""",
    "dq_not_null_customer": "select order_id from orders_null where customer_id is null",
    "dq_not_null_customer_window": """select order_id from orders_null where customer_id is null
        and order_date between date '1996-01-01' and date '1998-12-31'""",
    "dq_unique_orders": _SUITE["dq_unique_orders"],
    "dq_unique_orders_day": _UNIQUE.format("(select * from orders_dup where order_date = date '1997-05-28')"),
    "dq_unique_order_items": """select order_item_id, count(*) as cnt from stg_order_items
        group by order_item_id having count(*) > 1""",
    "dq_relationships_product": """select i.order_item_id, i.product_id from items_orphan i
        left join stg_products p on i.product_id = p.product_id where p.product_id is null""",
    "orphans_in_window": """select i.order_item_id from items_orphan i
        left join stg_products p on i.product_id = p.product_id
        where p.product_id is null and i.order_id in (select order_id from stg_orders
            where order_date between date '1996-01-01' and date '1998-12-31')""",
    "dq_accepted_channel": """select order_id, channel from orders_channel
        where channel not in ('web', 'mobile', 'store') or channel is null""",
    "dq_type_signup_date": """select signup_date
        from (select cast(signup_date as timestamp) as signup_date from stg_customers)
        where typeof(signup_date) <> 'DATE'""",
    "dq_not_empty": """select * from (select count(*) as row_count, 'revenue' as model from int_order_revenue
            union all select count(*), 'revenue_where_false' from int_order_revenue where 1 = 0)
        where row_count = 0""",
    "dq_expression_price": "select product_id from stg_products where unit_price >= 0",
    "dq_fact_grain": _SUITE["dq_fact_grain"],
    "dq_key_type_match": """select i.product_id from items_orphan i
        left join (select cast(product_id as varchar) as product_id from stg_products) p
          on i.product_id = cast(p.product_id as bigint) where p.product_id is null""",
    "dq_suite": "\n        union all ".join(
        f"select '{name}' as test_name, count(*) as violations, count(*) = 0 as passed from ({body})"
        for name, body in _SUITE.items()
    ),
    "anomaly_volume_drop": """select day, row_count, round(rolling_avg, 6) as rolling_avg from (
            select *, avg(row_count) over (order by day rows between 7 preceding and 1 preceding) as rolling_avg
            from (select cast(ts as date) as day, count(*) as row_count from faulty_volume group by 1))
        where row_count < rolling_avg * 0.5::double""",
    "anomaly_freshness_gap": """select day, last_seen, cast(day - cast(last_seen as date) as integer) as days_late
        from (select cast(unnest(generate_series(
                    (select min(cast(ts as date)) from faulty_stopped),
                    (select max(cast(ts as date)) from events), interval 1 day)) as date) as day,
                (select max(ts) from faulty_stopped) as last_seen)
        where day not in (select cast(ts as date) from faulty_stopped)""",
    "anomaly_null_rate": """select * from (select cast(ts as date) as day, count(*) as row_count,
            round(avg(case when user_id is null then 1.0 else 0.0 end)::double, 6) as null_rate
            from faulty_null group by 1)
        where null_rate > 0.2::double""",
    "anomaly_duplicates": """select * from (select cast(ts as date) as day, count(*) as row_count,
            count(distinct event_id) as distinct_keys,
            round(1 - count(distinct event_id)::double / count(*), 6) as duplicate_rate
            from faulty_replay group by 1)
        where duplicate_rate > 0.05::double""",
    "anomaly_distribution_shift": """select day, value, round(n / day_n, 6) as share,
            round(value_n / total_n, 6) as baseline_share
        from (select day, value, n::double as n, sum(n) over (partition by day)::double as day_n,
                sum(n) over (partition by value)::double as value_n, sum(n) over ()::double as total_n
              from (select cast(ts as date) as day, event_type as value, count(*) as n
                    from faulty_share group by 1, 2))
        where round(n / day_n, 6) - round(value_n / total_n, 6) > 0.2::double""",
    "anomaly_kpi_drop": f"""select a.day, a.revenue, b.revenue as revenue_week_ago
        from daily_value a join daily_value b on b.day = a.day - 7
        where a.revenue < b.revenue * 0.5::double""",
    "anomaly_dimension_missing": """select cast(day as date) as day, value
        from (select value, unnest(generate_series(first_day, (select max(cast(ts as date)) from faulty_missing),
                interval 1 day)) as day
              from (select event_type as value, min(cast(ts as date)) as first_day from faulty_missing group by 1))
        where (cast(day as date), value) not in (select cast(ts as date), event_type from faulty_missing)""",
    "anomaly_outliers": "select event_id, ts, value from faulty_outlier where value > 1000",
    "anomaly_orphan_rate": """select * from (select o.order_date as day, count(*) as item_count,
            count(*) filter (p.product_id is null) as orphan_count,
            round(count(*) filter (p.product_id is null)::double / count(*), 6) as orphan_rate
            from items_orphan i join stg_orders o on i.order_id = o.order_id
            left join stg_products p on i.product_id = p.product_id group by 1)
        where orphan_rate > 0""",
    "anomaly_missing_status": """select order_date, order_status, count(*) as missing_orders from stg_orders
        where order_status in ('completed', 'confirmed', 'shipped')
          and order_id in (select order_id from stg_order_items)
          and order_id not in (select order_id from fct_orders)
        group by order_date, order_status""",
    "failed_nodes": "select * from failures",
    "failed_nodes_from_json": "select * from failures",
    "failed_nodes_from_text": f"""select doc_id, 'dbt build' as command_executed,
            string_split(unique_id, '.')[1] as node_type, unique_id,
            string_split(unique_id, '.')[-1] as node_name,
            regexp_extract(message, {_quote(FILE_PATTERN)}, 1) as file_path, message as error_message
        from named_logs""",
    "failed_nodes_prioritised": """select run_id, sort_priority, unique_id, position, node_name, file_path
        from prioritised order by run_id, sort_priority, unique_id, position""",
    "error_categories": f"""select {_category('error_message')} as error_category, count(*) as node_count
        from failures group by 1""",
    "auto_fixable": f"""select event_id as run_id, unique_id, coalesce(error_category, 'unknown') as error_category,
            coalesce(error_category, 'unknown') not in ('infrastructure', 'config_error') as auto_fixable
        from events left join (
            select *, {_category('error_message')} as error_category, row_number() over (
                partition by run_id order by sort_priority, unique_id, position) as pick from prioritised) f
          on event_id = f.run_id and pick = 1""",
    "run_evaluation": f"""select m.run_id, coalesce(f.category, 'unknown') as error_category, m.failure_count_match,
            case when m.expected_failures > 1 then m.classifications_match
                 else coalesce(f.category, 'unknown') = e.single end as classification_match
        from matches m join (select run_id, min({_normal('error_type')}) as single from expected group by run_id) e
            on m.run_id = e.run_id
        left join (select run_id, {_category('error_message')} as category from (
            select *, row_number() over (partition by run_id order by position) as pick from failures)
            where pick = 1) f on m.run_id = f.run_id""",
    "message_categories": f"select conv_id, turn, {_category('text')} as error_category from conversations",
    "classifications_match": "select * from matches",
    "eval_summary": """select count(*) as runs,
            count(*) filter (classifications_match and failure_count_match) as passed,
            count(*) filter (failure_count_match) as count_matches,
            count(*) filter (classifications_match) as class_matches from matches""",
    "single_class_match": f"""select e.run_id, e.error_type,
            coalesce(case when f.run_id is not null then {_category('f.error_message')} end, 'unknown')
                = {_normal('e.error_type')} as matched
        from expected e left join (
            select * from (select *, row_number() over (partition by run_id order by position) as pick from failures)
            where pick = 1) f on e.run_id = f.run_id""",
    "message_file_paths": f"""select event_id, regexp_extract(
            {_list(artefacts.MESSAGES)}[event_id % 10 + 1], {_quote(FILE_PATTERN)}, 1) as file_path from events""",
    "normalized_error_types": f"""select error_type, {_normal('error_type')} as category, count(*) as failures
        from expected group by 1, 2""",
    "fix_files_match": """select 'INC-' || lpad(cast(event_id as varchar), 12, '0') as incident_id,
            case when event_id % 5 = 0 then false
                 when event_id % 5 <= 2 then event_id % 6 in (1, 2) or event_id % 4 = 1
                 else (event_id % 6 in (1, 2) or event_id % 4 = 1) and (event_id % 6 >= 3 or event_id % 4 = 0)
            end as fix_files_match
        from events""",
    "root_cause_file_match": """select 'INC-' || lpad(cast(event_id as varchar), 12, '0') as incident_id,
            case event_id % 4 when 0 then false when 1 then true when 2 then true
                 else event_id % 8 = 3 end as file_match
        from events""",
    "validation_passed": """select 'INC-' || lpad(cast(event_id as varchar), 12, '0') as incident_id,
            event_id % 3 = 0 as passed from events""",
    "report_confidence": """select doc_id, confidence,
            confidence < 0.7::double or contains(lower(report), 'infrastructure') as needs_human from rated""",
    "source_data_issue": rf"""select doc_id, len(list_filter(
            string_split_regex(report, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]'),
            lambda line: {_marked(_TRIMMED)} or (contains({_TRIMMED}, 'conclusion:') and
                {_marked(f"trim(substr({_TRIMMED}, position('conclusion:' in {_TRIMMED}) + 11), {SPACE})")})
            )) > 0 as source_data_issue
        from reports""",
    "question_intents": f"select conv_id, turn, {_intent(0)} as intent, {_intent(1)} as tools from conversations",
    "incidents_normalised": f"""select 'INC-' || lpad(cast(event_id as varchar), 12, '0') as incident_id,
            case when event_id % 3 <> 0 then 'dbt build'
                 when event_id * 3 % 9 = 0 then null
                 when event_id % 4 = 0 then 'Inconnue' else 'dbt build' end as command_executed,
            case when event_id % 3 = 0 and event_id * 3 % 9 = 0 then null else true end as has_errors,
            case when has_errors then string_split(node, '.')[1] end as node_type,
            case when has_errors then node end as unique_id,
            case when has_errors then string_split(node, '.')[-1] end as node_name,
            case when has_errors then case when event_id % 3 <> 0 then ''
                 when event_id % 2 = 0 then 'models/given.sql'
                 else regexp_extract(message, {_quote(FILE_PATTERN)}, 1) end end as file_path,
            case when has_errors then message end as error_message
        from (select event_id, {_list(artefacts.NODE_IDS)}[event_id % 4 + 1] as node,
                {_list(artefacts.MESSAGES)}[event_id % 10 + 1] as message from events)""",
    "incidents_latest": """select 'INC-' || lpad(cast(event_id as varchar), 12, '0') as incident_id,
            ts as created_at, event_type as scenario_id from events order by created_at desc, incident_id desc""",
    "lineage_edges": "select child, parent from edges",
    "lineage_upstream": "select * from upstream",
    "lineage_downstream": "select * from downstream",
    "lineage_distance": """select origin as failed_id, unique_id, cast(-min(distance) as integer) as lineage_level
        from up where distance > 0 and unique_id in (select unique_id from nodes where resource_type = 'model')
        group by 1, 2
        union all
        select origin, unique_id, cast(min(distance) as integer)
        from down where distance > 0 and unique_id in (select unique_id from nodes where resource_type = 'model')
        group by 1, 2""",
    "lineage_summary": """select part, count(*) filter (resource_type = 'model') as model_count,
            count(*) as node_count
        from (select unique_id, 'failed' as part from failed_ids
              union all select unique_id, 'upstream' from upstream
              union all select unique_id, 'downstream' from downstream) join nodes using (unique_id)
        group by part""",
    "lineage_depth3": """select origin as root_id, unique_id, name, cast(distance as integer) as level
        from near left join nodes using (unique_id) where distance <= 3""",
    "lineage_selected_nodes": """select unique_id, resource_type, name from nodes
        where unique_id in (select unique_id from up union select unique_id from down)""",
    "lineage_tests": """select e.parent as model_id, t.unique_id as test_id, t.name
        from edges e join nodes t on t.unique_id = e.child join nodes m on m.unique_id = e.parent
        where t.resource_type = 'test' and m.resource_type = 'model'""",
    "lineage_unknown_ids": "select 'node.' || (c_custkey + 1000000000) as unique_id from customer where c_custkey % 10 = 0",
    "dedup_events": "select distinct * from events",
    "stream_dedup": "select distinct * from events",
    "stream_finished_days": """select cast(ts as date) as day, count(*) as event_count, cast(0 as bigint) as late_count
        from events group by cast(ts as date)
        having cast(cast(ts as date) + interval 1 day as timestamp) <= (select max(ts) from events) - interval 2 days""",
    "stream_daily_volume": """select cast(ts as date) as day, count(*) as event_count, max(ts) as last_seen
        from events group by 1""",
    "stream_upsert": """select * exclude (pick) from (
            select *, row_number() over (partition by user_id order by ts desc, event_id desc) as pick from events)
        where pick = 1""",
}

FRAGMENTS["daily_value"] = f"""select cast(ts as date) as day, {MONEY.format('value')} as revenue
        from faulty_all group by 1"""

_DETECTED = {
    "volume_drop": BODIES["anomaly_volume_drop"],
    "null_rate_spike": BODIES["anomaly_null_rate"],
    "duplicates": BODIES["anomaly_duplicates"],
    "distribution_shift": BODIES["anomaly_distribution_shift"],
    "kpi_drop": BODIES["anomaly_kpi_drop"],
    "dimension_missing": BODIES["anomaly_dimension_missing"],
    "outliers": BODIES["anomaly_outliers"],
    "referential_integrity": BODIES["anomaly_orphan_rate"],
    "dbt_transformation_error": BODIES["anomaly_missing_status"],
    "freshness_gap": BODIES["anomaly_freshness_gap"],
}
_FAULTY = re.compile(r"\bfaulty_(volume|null|replay|share|missing|outlier)\b")
BODIES["detection_scores"] = f"""select tp / (tp + fp) as precision, tp / (tp + fn) as recall,
            2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) as f1,
            cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn
        from (select count(*) filter (hits > 0)::double as tp, 0::double as fp,
                10::double - count(*) filter (hits > 0)::double as fn
              from ({' union all '.join(
                  f"select '{name}' as name, count(*) as hits from ({_FAULTY.sub('faulty_all', body)})"
                  for name, body in _DETECTED.items())}))"""


BODIES["cube_daily_profile"] = f"""select day, row_count, null_rate, revenue, least, most,
            row_count - lag(row_count) over (order by day) as row_change
        from (select cast(ts as date) as day, count(*) as row_count,
                round(avg(case when user_id is null then 1.0 else 0.0 end)::double, 6) as null_rate,
                {MONEY.format('value')} as revenue, min(value) as least, max(value) as most
              from faulty_all group by 1)"""
BODIES["sketch_profile"] = " union all ".join(
    f"""select '{name}' as name, count(*) as row_count,
            round(avg(case when {name} is null then 1.0 else 0.0 end)::double, 6) as null_rate,
            {low} as low, {high} as high, true as distinct_close, {close} as quartiles_close
        from faulty_all where cast(ts as date) between date '2024-01-05' and date '2024-01-24'"""
    for name, low, high, close in (
        ("user_id", "min(user_id)::double", "max(user_id)::double", "true"),
        ("event_type", "null::double", "null::double", "null::boolean"),
        ("value", "min(value)", "max(value)", "true"),
    )
)
BODIES["cube_findings"] = " union all ".join(
    f"select distinct '{name}' as detector, {day} as day from ({_FAULTY.sub('faulty_all', _DETECTED[name])})"
    for name, day in {
        "volume_drop": "day",
        "null_rate_spike": "day",
        "distribution_shift": "day",
        "kpi_drop": "day",
        "dimension_missing": "day",
        "outliers": "cast(ts as date)",
    }.items()
)


def oracles() -> dict[str, str]:
    return {name: sql(body) for name, body in BODIES.items()}
