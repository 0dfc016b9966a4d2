"""The queries as plain SQL over the given tables, written independently of the jobs.

`COMMON` holds named subqueries; a query pulls in those it mentions.
"""

from __future__ import annotations

import re

from martflow import codes

STAMP = "'%Y-%m-%d %H:%M:%S'"


def stamp(col: str = "w") -> str:
    return (
        f"strftime({col}, {STAMP}) AS stt, strftime({col} + INTERVAL 5 SECONDS, {STAMP}) AS edt, "
        f"strftime({col}, '%Y-%m-%d') AS cur_date"
    )


def bucket(ts: str) -> str:
    return f"time_bucket(INTERVAL 5 SECONDS, {ts})"


def two_places(x: str) -> str:
    """Half-even on the exact binary value: the fraction in units of 2^-56."""
    units = f"(CAST(floor((({x}) - floor({x})) * 72057594037927936.0) AS BIGINT) * 100)"
    cents, rest = f"({units} >> 56)", f"({units} & 72057594037927935)"
    up = f"({rest} > 36028797018963968 OR ({rest} = 36028797018963968 AND {cents} % 2 = 1))"
    return f"(floor({x}) * 100 + {cents} + CASE WHEN {up} THEN 1 ELSE 0 END) / 100.0"


def priority(values: list[str]) -> str:
    cases = " ".join(f"WHEN '{i}' THEN '{v}'" for i, v in enumerate(values, 1))
    return f"CASE o_orderpriority[1] {cases} END"


PAY_TYPES = ["1101", "1102", "1103", "1104", "1199"]
REASONS = ["1301", "1302", "1303", "1304", "1399"]
_DIC = ", ".join(f"('{a}', '{b}')" for a, b in codes.DICTIONARY)

COMMON: dict[str, str] = {
    "dic": f"SELECT * FROM (VALUES {_DIC}) v(id, dic_name)",
    # ---- events
    "ev": """SELECT event_id AS seq, user_id, event_type, epoch_us(ts) // 1000 AS ts,
        make_timestamp((epoch_us(ts) // 1000) * 1000) AS et, CAST(props->>'k' AS INTEGER) AS k,
        CAST(value AS DECIMAL(16,2)) AS amount FROM events""",
    "traf": f"""SELECT seq, ts, et, event_type, 'mid_' || user_id AS mid,
        CAST(user_id AS VARCHAR) AS uid, user_id || '-' || strftime(et, '%Y%m%d') AS sid,
        'v' || (k // 25) AS vc, event_type AS ch,
        'area_' || length(CAST(user_id AS VARCHAR)) AS ar,
        CASE WHEN k >= 50 THEN '1' ELSE '0' END AS is_new,
        CASE event_type WHEN 'view' THEN '{codes.HOME}' WHEN 'click' THEN '{codes.DETAIL}'
            WHEN 'signup' THEN '{codes.LOGIN}' WHEN 'purchase' THEN 'payment' END AS page_id,
        CASE event_type WHEN 'signup' THEN '{codes.LOGIN}' WHEN 'click' THEN '{codes.HOME}'
            WHEN 'view' THEN '{codes.SEARCH}' WHEN 'purchase' THEN 'cart' END AS last_page_id,
        CAST(amount * 1000 AS BIGINT) AS during_time, CAST(et AS DATE) AS day, k FROM ev""",
    "raw_page": "SELECT * FROM traf WHERE page_id IS NOT NULL",
    "visit1": """SELECT mid, is_new AS new1, day AS day1 FROM traf
        QUALIFY row_number() OVER (PARTITION BY mid ORDER BY ts, seq) = 1""",
    "fixed": """SELECT traf.* EXCLUDE (is_new), CASE WHEN is_new = '1' AND
        (CASE WHEN new1 = '0' THEN day1 - 1 ELSE day1 END) < day THEN '0' ELSE is_new END AS is_new
        FROM traf JOIN visit1 USING (mid)""",
    "page": "SELECT * FROM fixed WHERE page_id IS NOT NULL",
    # cut-off lines do not reach the behaviour facts, nor the first-visit rule
    "blog": "SELECT * FROM traf WHERE NOT (event_type = 'signup' AND k = 0)",
    "bvisit1": """SELECT mid, is_new AS new1, day AS day1 FROM blog
        QUALIFY row_number() OVER (PARTITION BY mid ORDER BY ts, seq) = 1""",
    "bfixed": """SELECT blog.* EXCLUDE (is_new), CASE WHEN is_new = '1' AND
        (CASE WHEN new1 = '0' THEN day1 - 1 ELSE day1 END) < day THEN '0' ELSE is_new END AS is_new
        FROM blog JOIN bvisit1 USING (mid)""",
    "carts": """SELECT CAST(seq AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id,
        CAST(k AS VARCHAR) AS sku_id, CAST(amount AS VARCHAR) AS cart_price,
        'sku_' || k AS sku_name,
        CAST(CASE WHEN event_type = 'view' THEN k ELSE k - floor(amount) END AS BIGINT) AS sku_num,
        ts // 1000 AS ts, make_timestamp((ts // 1000) * 1000000) AS et, seq
        FROM ev WHERE event_type = 'view' OR (event_type = 'click' AND k > floor(amount))""",
    # ---- search words
    "search": """SELECT doc_id AS seq, text, lang,
        make_timestamp((1704067200 + doc_id) * 1000000) AS et FROM documents""",
    "doc_words": r"""SELECT DISTINCT seq, lang, et, word FROM (SELECT seq, lang, et,
        unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS word FROM search)
        WHERE word <> ''""",
    # ---- order lines
    "li": """SELECT *, l_orderkey || '-' || l_linenumber AS id,
        CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 1000000000
          + CAST(CAST(l_extendedprice AS DECIMAL(16,2)) * 100 AS BIGINT) AS seq,
        CAST(CAST(l_extendedprice AS DECIMAL(16,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(16,2)) AS total,
        CAST(CAST(l_extendedprice AS DECIMAL(16,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(16,2)) AS activity,
        CAST(CAST(l_extendedprice AS DECIMAL(16,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(16,2)) AS coupon
        FROM lineitem""",
    "lines": f"""SELECT id, CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS sku_id,
        CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS sku_num,
        total, activity, coupon, CAST(total AS VARCHAR) AS split_total_amount,
        CAST(activity AS VARCHAR) AS split_activity_amount,
        CAST(coupon AS VARCHAR) AS split_coupon_amount, o_orderdate AS created,
        strftime(o_orderdate, {STAMP}) AS create_time,
        CAST(epoch(o_orderdate) AS BIGINT) + l_linenumber AS ts, seq,
        o_orderdate + to_seconds(l_linenumber) AS et FROM li JOIN orders ON l_orderkey = o_orderkey""",
    "coupons": """SELECT id, CAST(l_suppkey AS VARCHAR) AS coupon_id,
        CAST(l_orderkey AS VARCHAR) AS coupon_use_id FROM li WHERE l_tax > 0.04
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1""",
    "activities": """SELECT id, CAST(l_suppkey AS VARCHAR) AS activity_id,
        CAST(l_partkey AS VARCHAR) AS activity_rule_id FROM li WHERE l_discount > 0.05
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1""",
    "placed": """SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS user_id,
        CAST(c_nationkey AS VARCHAR) AS province_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "versions": """SELECT lines.*, user_id, province_id, coupon_id, coupon_use_id, activity_id,
        activity_rule_id FROM lines LEFT JOIN placed USING (order_id) LEFT JOIN coupons USING (id)
        LEFT JOIN activities USING (id)""",
    "last_lines": """SELECT * FROM versions
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1""",
    "first_lines": "SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1",
    "cancels": f"""SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(epoch(o_orderdate) AS BIGINT) + 600 AS ts,
        strftime(o_orderdate + INTERVAL 600 SECONDS, {STAMP}) AS cancel_time, o_orderkey AS seq
        FROM orders WHERE o_orderstatus = 'O'""",
    "pays": f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id,
        CAST(o_orderkey AS VARCHAR) AS order_id, 'T' || o_orderkey AS trade_no,
        CAST(CAST(o_totalprice AS DECIMAL(16,2)) AS VARCHAR) AS total_amount, '1602' AS payment_status,
        {priority(PAY_TYPES)} AS payment_type,
        CAST(epoch(o_orderdate) AS BIGINT) + CAST(CAST(o_totalprice AS DECIMAL(16,2)) * 100 AS BIGINT) // 20000 AS ts,
        o_orderkey AS seq FROM orders WHERE o_orderstatus <> 'P'""",
    "pay": f"""SELECT * REPLACE (CAST(ts AS BIGINT) AS ts), make_timestamp(CAST(ts AS BIGINT) * 1000000) AS et,
        strftime(make_timestamp(CAST(ts AS BIGINT) * 1000000), {STAMP}) AS callback_time FROM pays""",
    "paid": """SELECT pay.*, l.* EXCLUDE (id, order_id, user_id, ts, et, seq), l.id AS detail_id,
        d1.dic_name AS payment_status_name, d2.dic_name AS payment_type_name FROM pay
        JOIN last_lines l ON pay.order_id = l.order_id AND l.et BETWEEN pay.et - INTERVAL 30 MINUTES AND pay.et
        LEFT JOIN dic d1 ON payment_status = d1.id LEFT JOIN dic d2 ON payment_type = d2.id""",
    "granted": f"""SELECT id, CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_orderkey AS VARCHAR) AS order_id,
        CAST(l_partkey AS VARCHAR) AS sku_id, CASE WHEN l_linestatus = 'F' THEN '1501' ELSE '1502' END AS refund_type,
        CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS refund_num,
        CAST(CAST(l_extendedprice AS DECIMAL(16,2)) AS VARCHAR) AS refund_amount,
        {priority(REASONS)} AS refund_reason_type, l_linestatus AS refund_reason_txt,
        strftime(l_shipdate, {STAMP}) AS operate_time, CAST(epoch(l_shipdate) AS BIGINT) AS ts, l_shipdate AS et, seq
        FROM li JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""",
    "refunded": """SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(c_nationkey AS VARCHAR) AS province_id
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'""",
    "refunded_at": """SELECT refunded.*, CAST(epoch(o_orderdate) AS BIGINT) + 86400 AS ts
        FROM refunded JOIN orders ON order_id = CAST(o_orderkey AS VARCHAR)""",
    "refunds": """SELECT granted.*, province_id, d1.dic_name AS refund_type_name,
        d2.dic_name AS refund_reason_type_name FROM granted JOIN refunded USING (order_id)
        LEFT JOIN dic d1 ON refund_type = d1.id LEFT JOIN dic d2 ON refund_reason_type = d2.id""",
    "refund_pays": f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderkey AS VARCHAR) AS order_id,
        'O' || o_orderkey AS out_trade_no, '1602' AS refund_status, {priority(PAY_TYPES)} AS payment_type,
        'T' || o_orderkey AS trade_no, CAST(epoch(o_orderdate) AS BIGINT) + 172800 AS ts,
        strftime(o_orderdate + INTERVAL 2 DAYS, {STAMP}) AS callback_time, o_orderkey AS seq
        FROM orders WHERE o_orderstatus = 'F'""",
    "refunds_paid": """SELECT p.*, r.user_id, r.sku_id, r.refund_type, r.refund_num, r.refund_amount,
        r.refund_reason_type, r.refund_reason_txt, r.province_id, r.refund_type_name,
        r.refund_reason_type_name, d1.dic_name AS refund_status_name, d2.dic_name AS payment_type_name
        FROM refund_pays p JOIN refunds r USING (order_id)
        LEFT JOIN dic d1 ON refund_status = d1.id LEFT JOIN dic d2 ON payment_type = d2.id""",
    "comments": f"""SELECT conv_id || '-' || turn AS id, CAST(conv_id AS VARCHAR) AS user_id,
        CAST(turn AS VARCHAR) AS sku_id, CAST(turn AS VARCHAR) AS spu_id, CAST(conv_id AS VARCHAR) AS order_id,
        '120' || least(turn + 1, 4) AS appraise, text AS comment_txt,
        strftime(make_timestamp((1704067200 + conv_id) * 1000000), {STAMP}) AS create_time,
        1704067200 + conv_id AS ts, conv_id * 1000 + turn AS seq FROM conversations WHERE role = 'user'""",
    # ---- routing
    "routed": """SELECT 'dwd_user_register' AS sink_table, 'user_info' AS tab, 'insert' AS source_type, 'insert' AS op_type,
          CAST(user_id AS VARCHAR) AS id, ts // 1000 AS ts, seq, 'create_time,id,op_type' AS columns
          FROM ev WHERE event_type = 'signup'
        UNION ALL SELECT 'dwd_cart', 'cart_info', 'update,delete', 'update', CAST(seq AS VARCHAR), ts // 1000, seq, 'id,op_type,sku_num,user_id'
          FROM ev WHERE event_type = 'click'
        UNION ALL SELECT 'dwd_comment', 'comment_info', 'ALL', 'insert', id, ts, seq, 'appraise,id,op_type' FROM comments""",
    "routes": """SELECT o_orderkey AS seq, CAST(epoch(o_orderdate) AS BIGINT) AS ts,
        CASE o_orderstatus WHEN 'O' THEN 'c' WHEN 'P' THEN 'u' ELSE 'd' END AS op,
        'table_' || o_custkey AS source_table, 'dim_' || o_custkey AS sink_table, o_orderpriority AS source_type,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'DWD' ELSE 'DIM' END AS sink_type FROM orders""",
    "route_log": """SELECT o_orderkey AS seq, CAST(epoch(o_orderdate) AS BIGINT) AS ts,
        CASE o_orderstatus WHEN 'O' THEN 'c' WHEN 'P' THEN 'u' ELSE 'd' END AS op,
        'table_' || o_custkey AS source_table, 'dim_' || o_custkey AS sink_table,
        CASE o_orderpriority[1] WHEN '1' THEN ['insert', 'update', 'delete'] WHEN '2' THEN ['insert']
          WHEN '3' THEN ['update', 'delete'] ELSE ['insert', 'update'] END AS wanted, o_orderpriority[1] < '4' AS named FROM orders""",
    "line_changes": """SELECT 'table_' || l_suppkey AS tab, CASE WHEN l_returnflag = 'R' THEN 'delete' WHEN l_linestatus = 'F' THEN 'update'
        ELSE 'insert' END AS op_type, CAST(epoch(l_shipdate) AS BIGINT) AS ts, CAST(l_partkey AS VARCHAR) AS id, id AS name, seq FROM li""",
    "spans": """SELECT *, lead(ts) OVER (PARTITION BY source_table ORDER BY ts, seq) AS until FROM route_log""",
    "as_of": """SELECT sink_table, op_type, c.ts, c.seq, c.id, CASE WHEN named THEN name END AS name FROM line_changes c
        JOIN spans s ON tab = source_table AND c.ts >= s.ts AND (until IS NULL OR c.ts < until)
        WHERE op <> 'd' AND list_contains(wanted, op_type)""",
    "lives": """SELECT sink_table, coalesce(max(ts) FILTER (op IN ('u', 'd')), -1) AS born FROM route_log
        GROUP BY sink_table HAVING arg_max(op, (ts, seq)) <> 'd'""",
    # ---- dimensions
    "sku": f"""SELECT CAST(p_partkey AS VARCHAR) AS sku_id, p_name AS sku_name,
        CAST(CAST(p_retailprice AS DECIMAL(16,2)) AS VARCHAR) AS price,
        CAST(p_partkey // 10 AS VARCHAR) AS spu_id,
        min(p_name) OVER (PARTITION BY p_partkey // 10) AS spu_name,
        split_part(p_brand, '#', 2) AS trademark_id, p_brand AS trademark_name,
        CAST(s_suppkey AS VARCHAR) AS category3_id, s_name AS category3_name,
        CAST(n_nationkey AS VARCHAR) AS category2_id, n_name AS category2_name,
        CAST(r_regionkey AS VARCHAR) AS category1_id, r_name AS category1_name
        FROM part LEFT JOIN supplier ON p_size = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey""",
    # ---- window tables
    "w_keyword": f"""SELECT {bucket('et')} AS w, word AS keyword, count(*) AS keyword_count FROM doc_words
        WHERE lang IN ('en', 'fr') GROUP BY ALL""",
    "firsts": """SELECT *, row_number() OVER (PARTITION BY mid, day ORDER BY ts, seq) AS nth_of_day,
        row_number() OVER (PARTITION BY sid ORDER BY ts, seq) AS nth_of_session FROM page""",
    "w_traffic": f"""SELECT {bucket('et')} AS w, vc, ch, ar, is_new,
        count(*) FILTER (nth_of_day = 1) AS uv_ct, count(*) FILTER (nth_of_session = 1) AS sv_ct,
        count(*) AS pv_ct, CAST(sum(during_time) AS BIGINT) AS dur_sum FROM firsts GROUP BY ALL""",
    "w_home_detail": f"""SELECT {bucket('et')} AS w, count(*) FILTER (page_id = 'home') AS home_uv_ct,
        count(*) FILTER (page_id = 'good_detail') AS good_detail_uv_ct FROM (SELECT *,
        row_number() OVER (PARTITION BY mid, page_id, day ORDER BY ts, seq) AS nth FROM raw_page
        WHERE page_id IN ('home', 'good_detail')) WHERE nth = 1 GROUP BY ALL""",
    "login_days": """SELECT *, lag(day) OVER (PARTITION BY uid ORDER BY day) AS before FROM (SELECT * FROM raw_page
        WHERE last_page_id = 'login' QUALIFY row_number() OVER (PARTITION BY uid, day ORDER BY ts, seq) = 1)""",
    "back": "SELECT *, CASE WHEN day - before > 7 THEN 1 ELSE 0 END AS back_ct FROM login_days",
    "w_user_login": f"""SELECT {bucket('et')} AS w, CAST(sum(back_ct) AS BIGINT) AS back_ct,
        count(*) AS uu_ct FROM back GROUP BY ALL""",
    "w_cart_add_uu": f"""SELECT {bucket('et')} AS w, count(DISTINCT user_id) AS cart_add_uu_ct
        FROM carts GROUP BY ALL""",
    "pay_days": """SELECT *, CAST(et AS DATE) AS day, CASE WHEN CAST(et AS DATE) =
        min(CAST(et AS DATE)) OVER (PARTITION BY user_id) THEN 1 ELSE 0 END AS new_ct FROM paid
        QUALIFY row_number() OVER (PARTITION BY user_id, CAST(et AS DATE) ORDER BY ts, seq) = 1""",
    "w_payment_suc": f"""SELECT {bucket('et')} AS w, count(*) AS payment_suc_unique_user_count,
        CAST(sum(new_ct) AS BIGINT) AS payment_suc_new_user_count FROM pay_days GROUP BY ALL""",
    "order_firsts": """SELECT *, min(created) OVER (PARTITION BY user_id, CAST(created AS DATE) ORDER BY et) AS today,
        min(created) OVER (PARTITION BY user_id ORDER BY et) AS ever FROM versions WHERE user_id IS NOT NULL""",
    "w_order": f"""SELECT {bucket('et')} AS w,
        count(DISTINCT CASE WHEN created = today THEN user_id END) AS order_unique_user_count,
        count(DISTINCT CASE WHEN created = ever THEN user_id END) AS order_new_user_count
        FROM order_firsts GROUP BY ALL""",
    "sku_sums": f"""SELECT {bucket('created')} AS w, sku_id, CAST(sum(CAST(sku_num AS INTEGER)) AS BIGINT) AS sku_num,
        sum(activity) AS activity_reduce_amount, sum(coupon) AS coupon_reduce_amount, sum(total) AS order_amount
        FROM first_lines GROUP BY ALL""",
    "w_sku_order": """SELECT w, CAST(trademark_id AS BIGINT) AS trademark_id, trademark_name,
        CAST(category1_id AS BIGINT) AS category1_id, category1_name, CAST(category2_id AS BIGINT) AS category2_id,
        category2_name, CAST(category3_id AS BIGINT) AS category3_id, category3_name,
        CAST(sku_id AS BIGINT) AS sku_id, sku_name, CAST(spu_id AS BIGINT) AS spu_id, spu_name,
        sku_num * CAST(price AS DECIMAL(16,2)) AS original_amount, activity_reduce_amount,
        coupon_reduce_amount, order_amount FROM sku_sums LEFT JOIN sku USING (sku_id)""",
    # the average of a line's versions has six decimals: whole millionths, rounded half up
    "line_avgs": f"""SELECT {bucket('created')} AS w, id, province_id, order_id,
        (2 * 10000 * CAST(sum(CAST(total * 100 AS BIGINT)) AS HUGEINT) + count(*)) // (2 * count(*)) AS micros
        FROM versions WHERE province_id IS NOT NULL GROUP BY ALL""",
    "w_province": """SELECT w, province_id, count(DISTINCT order_id) AS order_count, sum(micros) AS micros
        FROM line_avgs GROUP BY ALL""",
    "w_province_order": """SELECT w, CAST(province_id AS BIGINT) AS province_id, n_name AS province_name,
        order_count, CAST((2 * micros + 10000) // 20000 AS BIGINT) AS cents
        FROM w_province LEFT JOIN nation ON province_id = CAST(n_nationkey AS VARCHAR)""",
    "w_refund": f"""SELECT {bucket('et')} AS w, trademark_id, trademark_name, category1_id, category1_name,
        category2_id, category2_name, category3_id, category3_name, user_id, count(*) AS refund_count
        FROM refunds LEFT JOIN sku USING (sku_id) GROUP BY ALL""",
    "d_traffic": "SELECT *, strftime(w, '%Y-%m-%d') AS cur_date FROM w_traffic",
    "d_sku": "SELECT *, strftime(w, '%Y-%m-%d') AS cur_date FROM w_sku_order",
    "d_refund": "SELECT *, strftime(w, '%Y-%m-%d') AS cur_date FROM w_refund",
    "d_province": "SELECT *, strftime(w, '%Y-%m-%d') AS cur_date FROM w_province_order",
    "dim_log": """SELECT 'dim_province' AS sink_table, n_nationkey AS k, n_name AS name, 1 AS ts, 'insert' AS op_type,
          'id,name,op_type' AS columns FROM nation
        UNION ALL SELECT 'dim_category3', s_suppkey, s_name, 1, 'insert', 'category2_id,id,name,op_type' FROM supplier
        UNION ALL SELECT 'dim_category3', s_suppkey, upper(s_name), 2, 'update', 'category2_id,id,name,op_type' FROM supplier WHERE s_acctbal >= 5000
        UNION ALL SELECT 'dim_category3', s_suppkey, s_name, 3, 'delete', 'category2_id,id,name,op_type' FROM supplier WHERE s_acctbal < 0
        UNION ALL SELECT 'dim_user', c_custkey, c_name, 1, 'insert', 'id,name,op_type' FROM customer
        UNION ALL SELECT 'dim_user', c_custkey, c_name, 3, 'delete', 'id,name,op_type' FROM customer WHERE c_acctbal < 0""",
    "order_states": """SELECT o_custkey AS row_key, o_orderkey AS seq, o_totalprice AS price, o_orderstatus
        FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
}


def with_common(body: str) -> str:
    """The query preceded by the named subqueries it needs, in order of definition."""
    needed: set[str] = set()

    def collect(text: str) -> None:
        for name in COMMON:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                collect(COMMON[name])

    collect(body)
    parts = ",\n".join(f"{name} AS ({COMMON[name]})" for name in COMMON if name in needed)
    return f"WITH {parts}\n{body}" if parts else body


def _window(table: str, columns: str) -> str:
    return f"SELECT {stamp()}, {columns} FROM {table}"


def _daily(table: str, measure: str) -> str:
    return (
        f"SELECT strftime(w, '%Y-%m-%d') AS cur_date, CAST(sum({measure}) AS BIGINT) AS n "
        f"FROM {table} GROUP BY ALL"
    )


def _labelled(value: str, *branches: tuple[str, str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT cur_date, '{label}' AS name, n AS {value} FROM ({_daily(table, measure)})"
        for label, table, measure in branches
    )


def _goods(ids: list[str], names: list[str]) -> str:
    keys = ", ".join(ids + names)
    on = " AND ".join(f"a.{i} = b.{i}" for i in ["cur_date", *ids])
    both = ", ".join(f"coalesce(a.{x}, b.{x}) AS {x}" for x in ["cur_date", *ids, *names])
    text = ", ".join(f"CAST({i} AS VARCHAR) AS {i}" for i in ids)
    return f"""SELECT {both}, CAST(order_amount AS DOUBLE) AS order_amount, refund_count, refund_uu_count
        FROM (SELECT cur_date, {text}, {', '.join(names)}, sum(order_amount) AS order_amount FROM d_sku GROUP BY ALL) a
        FULL JOIN (SELECT cur_date, {keys}, CAST(sum(refund_count) AS BIGINT) AS refund_count,
          count(DISTINCT user_id) AS refund_uu_count FROM d_refund GROUP BY ALL) b ON {on}"""


_SKU = "sku_id, CAST(order_amount AS DOUBLE) AS order_amount"
_MONEY = ", ".join(
    f"CAST({x} AS DOUBLE) AS {x}"
    for x in ("activity_reduce_amount", "coupon_reduce_amount", "order_amount")
)
_LINE = (
    "id, order_id, sku_id, sku_num, split_total_amount, split_activity_amount, split_coupon_amount, "
    "create_time, user_id, province_id, coupon_id, coupon_use_id, activity_id, activity_rule_id"
)
_CHANGE = """SELECT o_orderkey AS seq, 'order_info' AS "table", {type} AS type,
    CAST(epoch(o_orderdate) AS BIGINT) AS ts, CAST(o_orderkey AS VARCHAR) AS id,
    CAST(o_custkey AS VARCHAR) AS user_id FROM orders WHERE o_orderpriority[1] IN ({levels})"""
_TRAFFIC = "vc, ch, ar, is_new, uv_ct, sv_ct, pv_ct, dur_sum"
_REFUND = (
    "trademark_id, trademark_name, category1_id, category1_name, category2_id, category2_name, "
    "category3_id, category3_name, user_id, refund_count"
)
_R6 = """SELECT cur_date, is_new, CAST(sum(uv_ct) AS BIGINT) AS uv_ct, CAST(sum(pv_ct) AS BIGINT) AS pv_ct,
    CAST(sum(sv_ct) AS BIGINT) AS sv_ct, CAST(sum(dur_sum) AS BIGINT) AS dur_sum FROM d_traffic GROUP BY ALL"""
_R6 = f"""SELECT *, CASE WHEN sv_ct = 0 THEN 0.0 ELSE {two_places("CAST(dur_sum AS DOUBLE) / sv_ct / 1000")} END AS avg_dur_sum,
    CASE WHEN sv_ct = 0 THEN 0.0 ELSE {two_places("CAST(pv_ct AS DOUBLE) / sv_ct")} END AS avg_pv_ct FROM ({_R6})"""


# Joins with a span of 300 days, and what finds nobody within it.
_WITHIN = {
    "j2": """SELECT g.id, g.seq, g.order_id, g.sku_id, r.province_id, r.order_id IS NOT NULL AS matched FROM granted g
        LEFT JOIN refunded_at r ON g.order_id = r.order_id AND abs(g.ts - r.ts) <= 300 * 86400""",
    "j4": """SELECT p.id, p.order_id, r.sku_id, r.refund_amount, p.out_trade_no, r.order_id IS NOT NULL AS matched FROM refund_pays p
        LEFT JOIN (SELECT g.* FROM granted g JOIN refunded_at r ON g.order_id = r.order_id AND abs(g.ts - r.ts) <= 300 * 86400) r
        ON p.order_id = r.order_id AND abs(p.ts - r.ts) <= 300 * 86400""",
}


def _bodies() -> dict[str, str]:
    q: dict[str, str] = {
        "p1_valid_change_log": _CHANGE.format(
            type="CASE o_orderpriority[1] WHEN '2' THEN 'bootstrap-insert' ELSE 'insert' END",
            levels="'2', '5'"),
        "p2_valid_fact_changes": _CHANGE.format(type="'insert'", levels="'5'"),
        "p3_valid_behaviour_log": "SELECT seq, ts, mid FROM blog",
        "p5_status_transition": "SELECT order_id AS id, cancel_time AS operate_time, ts, seq FROM cancels",
        "p6_column_changed": "SELECT order_id AS id, province_id FROM refunded",
        "p7_cart_delta": "SELECT id, sku_num FROM carts",
        "p11_column_prune": "SELECT sink_table, id, columns FROM routed",
        "p14_flatten": """SELECT seq, mid, ts, CASE WHEN event_type = 'error' THEN 'icon' END AS entry,
            CAST(k AS VARCHAR) AS error_code, CASE WHEN event_type = 'error'
              THEN 'ar,ch,entry,error_code,is_new,loading_time,mid,sid,ts,uid,vc'
              ELSE 'ar,ch,during_time,error_code,is_new,last_page_id,mid,page_id,sid,ts,uid,vc' END AS columns
            FROM traf WHERE event_type = 'error' OR event_type = 'click' AND k >= 90""",
        "t11_route_as_of": "SELECT * FROM as_of",
        "m5_dimension_life": """SELECT sink_table, row_key, op_type, ts, seq, name FROM (
            SELECT as_of.sink_table, id AS row_key, op_type, ts, seq, name FROM as_of JOIN lives ON as_of.sink_table = lives.sink_table AND ts >= born
            QUALIFY row_number() OVER (PARTITION BY as_of.sink_table, id ORDER BY ts DESC, seq DESC) = 1) WHERE op_type <> 'delete'""",
        "j1_left_chain": """SELECT id, seq, order_id, user_id, province_id, coupon_id, coupon_use_id,
            activity_id, activity_rule_id FROM versions""",
        "j2_inner_updates": "SELECT id, seq, order_id, sku_id, province_id FROM granted JOIN refunded USING (order_id)",
        "j3_latest_version_join": """SELECT id, order_id, seq, cancel_time FROM (SELECT * FROM lines QUALIFY
            row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) JOIN (SELECT order_id, cancel_time FROM cancels) USING (order_id)""",
        "j4_refund_fanout": "SELECT id, order_id, sku_id, refund_amount, out_trade_no FROM refunds_paid",
        "j5_interval_join": """SELECT p.uid AS pay_uid, p.seq AS pay_seq, v.seq AS view_seq FROM traf p JOIN traf v
            ON p.uid = v.uid AND v.et BETWEEN p.et - INTERVAL 30 MINUTES AND p.et
            WHERE p.event_type = 'purchase' AND v.event_type = 'view'""",
        "j6_lookup": "SELECT c.id, appraise, dic_name AS appraise_name FROM comments c LEFT JOIN dic ON appraise = dic.id",
        "j7_double_lookup": """SELECT pay.id, payment_status, d1.dic_name AS payment_status_name, payment_type,
            d2.dic_name AS payment_type_name FROM pay LEFT JOIN dic d1 ON payment_status = d1.id
            LEFT JOIN dic d2 ON payment_type = d2.id""",
        "j8_snowflake": "SELECT * FROM sku",
        "j9_enrich": """SELECT id, seq, sku_id, trademark_name, category3_name, category2_name, category1_name
            FROM granted LEFT JOIN sku USING (sku_id)""",
        "j11_route": 'SELECT sink_table, tab AS "table", op_type, id, seq FROM routed',
        "j12_window_join": f"""SELECT {stamp()}, views, clicks FROM
            (SELECT {bucket('et')} AS w, count(*) AS views FROM traf WHERE event_type = 'view' GROUP BY ALL) JOIN
            (SELECT {bucket('et')} AS w, count(*) AS clicks FROM traf WHERE event_type = 'click' GROUP BY ALL) USING (w)""",
        "j13_full_outer": """SELECT user_id, CAST(paid_amount AS DOUBLE) AS paid_amount, cart_num FROM
            (SELECT user_id, sum(CAST(total_amount AS DECIMAL(16,2))) AS paid_amount FROM pay GROUP BY ALL) FULL JOIN
            (SELECT user_id, CAST(sum(sku_num) AS BIGINT) AS cart_num FROM carts GROUP BY ALL) USING (user_id)""",
        "j14_explode_words": "SELECT seq, word FROM doc_words",
        "x1_lexicon_words": """SELECT doc_id AS seq, word FROM documents JOIN (SELECT DISTINCT
            unnest(string_split(lower(p_name), ' ')) AS word FROM part) ON contains(lower(text), word)""",
        "a1_window_count": f"SELECT {stamp()}, n FROM (SELECT {bucket('et')} AS w, count(*) AS n FROM traf GROUP BY ALL)",
        "a2_window_key_count": f"""SELECT {stamp()}, event_type, n FROM
            (SELECT {bucket('et')} AS w, event_type, count(*) AS n FROM traf GROUP BY ALL)""",
        "a3_window_distinct": f"""SELECT {stamp()}, users FROM
            (SELECT {bucket('et')} AS w, count(DISTINCT uid) AS users FROM traf GROUP BY ALL)""",
        "a4_conditional_distinct": f"""SELECT {stamp()}, buyers FROM (SELECT {bucket('et')} AS w,
            count(DISTINCT CASE WHEN event_type = 'purchase' THEN uid END) AS buyers FROM traf GROUP BY ALL)""",
        "a5_sku_amount": f"SELECT {stamp()}, sku_id, sku_num, {_MONEY} FROM sku_sums",
        "a6_two_level": f"""SELECT {stamp()}, province_id, order_count,
            CAST(micros AS DOUBLE) / 1000000 AS order_amount FROM w_province""",
        "a7_traffic_reduce": f"""SELECT {stamp()}, vc, ch, ar, is_new, count(*) FILTER (a = 1) AS uv_ct,
            count(*) FILTER (b = 1) AS sv_ct, count(*) AS pv_ct, CAST(sum(during_time) AS BIGINT) AS dur_sum FROM
            (SELECT *, {bucket('et')} AS w, row_number() OVER (PARTITION BY mid, day ORDER BY ts, seq) AS a,
            row_number() OVER (PARTITION BY sid ORDER BY ts, seq) AS b FROM raw_page) GROUP BY w, vc, ch, ar, is_new""",
        "a8_refund_reduce": f"""SELECT {stamp()}, sku_id, user_id, n AS refund_count FROM
            (SELECT {bucket('et')} AS w, sku_id, user_id, count(*) AS n FROM granted GROUP BY ALL)""",
        "a9_global_window": f"""SELECT {stamp()}, dur_sum, pv_ct FROM (SELECT {bucket('et')} AS w,
            CAST(sum(during_time) AS BIGINT) AS dur_sum, count(*) AS pv_ct FROM raw_page GROUP BY ALL)""",
        "a10_daily_rollup": """SELECT strftime(day, '%Y-%m-%d') AS cur_date, ch,
            CAST(sum(during_time) AS BIGINT) AS dur_sum FROM raw_page GROUP BY ALL""",
        "a11_conditional_sum": """SELECT hour(et) AS hr, CAST(sum(CASE WHEN is_new = '1' THEN during_time ELSE 0 END) AS BIGINT) AS new_dur
            FROM raw_page GROUP BY ALL""",
        "a12_ratio": f"""SELECT ch, {two_places("CAST(sum(during_time) AS DOUBLE) / count(*)")} AS dur_per_page
            FROM raw_page GROUP BY ALL""",
        "a13_global_sum": "SELECT CAST(sum(total) AS DOUBLE) AS order_amount FROM lines",
        "w1_first_version": "SELECT id, seq, sku_id, split_total_amount FROM first_lines",
        "w2_latest_version": """SELECT id, seq, sku_id, split_total_amount FROM lines QUALIFY
            row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1""",
        "w3_first_of_day": """SELECT seq, uid, min(during_time) OVER (PARTITION BY uid, day ORDER BY et) AS least_so_far FROM traf""",
        "w4_first_ever": "SELECT seq, uid, min(during_time) OVER (PARTITION BY uid ORDER BY et) AS least_so_far FROM traf",
        "w5_first_visit_fix": "SELECT seq, mid, is_new FROM fixed",
        "w6_daily_unique": """SELECT seq, mid, ts, CASE WHEN row_number() OVER
            (PARTITION BY mid, day ORDER BY ts, seq) = 1 THEN 1 ELSE 0 END AS uv_ct FROM raw_page""",
        "w7_session_first": """SELECT seq, sid, ts, CASE WHEN row_number() OVER
            (PARTITION BY sid ORDER BY ts, seq) = 1 THEN 1 ELSE 0 END AS sv_ct FROM raw_page""",
        "w8_backflow": "SELECT seq, uid, ts, back_ct, 1 AS uu_ct FROM back",
        "w9_page_unique": """SELECT seq, mid, page_id, ts FROM raw_page QUALIFY
            row_number() OVER (PARTITION BY mid, page_id, day ORDER BY ts, seq) = 1""",
        "w10_first_payment": """SELECT seq, user_id, ts * 1000 AS ts, CASE WHEN CAST(et AS DATE) =
            min(CAST(et AS DATE)) OVER (PARTITION BY user_id) THEN 1 ELSE 0 END AS new_ct, 1 AS unique_ct FROM pay
            QUALIFY row_number() OVER (PARTITION BY user_id, CAST(et AS DATE) ORDER BY ts, seq) = 1""",
        "m1_config_parse": "SELECT seq, op, source_table, sink_type, sink_table FROM routes",
        "m2_active_config": """SELECT source_table, seq, op, source_type FROM (SELECT * FROM routes WHERE sink_type = 'DIM'
            QUALIFY row_number() OVER (PARTITION BY source_table ORDER BY ts DESC, seq DESC) = 1) WHERE op <> 'd'""",
        "m3_op_filter": "SELECT sink_table, source_type, op_type, count(*) AS n FROM routed GROUP BY ALL",
        "m4_dim_compaction": "SELECT row_key, seq, price FROM order_states WHERE o_orderstatus <> 'F'",
        "m4_dim_increment": "SELECT row_key, seq, price FROM order_states WHERE o_orderstatus <> 'F'",
        "t13_explode_actions": """SELECT seq, pos, mid, ts + 1000 * (pos + 1) AS ts, 'a' || (pos + 1) AS action_id, page_id, is_new
            FROM bfixed, (VALUES (0), (1)) v(pos) WHERE event_type = 'purchase' OR event_type = 'click' AND pos = 0""",
        "d0_dimensions": """SELECT sink_table, CAST(k AS VARCHAR) AS row_key, name, op_type, columns FROM (SELECT * FROM dim_log
            QUALIFY row_number() OVER (PARTITION BY sink_table, k ORDER BY ts DESC) = 1) WHERE op_type <> 'delete'""",
        "d1_start": """SELECT seq, mid, ts, is_new, 'icon' AS entry, CAST(k AS VARCHAR) AS loading_time
            FROM bfixed WHERE event_type = 'error'""",
        "d1_page": """SELECT seq, mid, ts, is_new, sid, page_id, last_page_id,
            CAST(during_time AS VARCHAR) AS during_time FROM bfixed WHERE page_id IS NOT NULL""",
        "d1_display": """SELECT seq, pos, mid, ts, is_new, CAST(k + pos AS VARCHAR) AS item, page_id
            FROM bfixed, (VALUES (0), (1)) v(pos) WHERE event_type IN ('view', 'purchase')""",
        "d1_action": """SELECT seq, pos, mid, ts + 1000 * (pos + 1) AS ts, is_new, 'a' || (pos + 1) AS action_id, page_id
            FROM bfixed, (VALUES (0), (1)) v(pos) WHERE event_type = 'purchase' OR event_type = 'click' AND pos = 0""",
        "d1_err": """SELECT seq, mid, ts, is_new, CAST(k AS VARCHAR) AS error_code,
            CASE WHEN event_type = 'error' THEN 'icon' END AS entry
            FROM bfixed WHERE event_type = 'error' OR event_type = 'click' AND k >= 90""",
        "d2_comment_info": "SELECT c.*, dic_name AS appraise_name FROM comments c LEFT JOIN dic ON appraise = dic.id",
        "d3_cart_add": "SELECT * EXCLUDE (et) FROM carts",
        "d4_order_detail": f"SELECT {_LINE}, ts, seq FROM last_lines",
        "d5_cancel_detail": f"SELECT {_LINE}, last_lines.seq, cancels.ts, cancel_time FROM last_lines JOIN cancels USING (order_id)",
        "d6_pay_detail": """SELECT id, user_id, order_id, trade_no, total_amount, payment_status, payment_type, callback_time,
            ts, seq, detail_id, sku_id, sku_num, split_total_amount, split_activity_amount, split_coupon_amount, create_time,
            province_id, coupon_id, coupon_use_id, activity_id, activity_rule_id, payment_status_name, payment_type_name FROM paid""",
        "d7_refund": "SELECT * EXCLUDE (et) FROM refunds",
        "d8_refund_payment": "SELECT * FROM refunds_paid",
        "d9_routed_facts": "SELECT sink_table, id, op_type, ts, seq, columns FROM routed",
        "g1_keyword": _window("w_keyword", "keyword, keyword_count"),
        "g2_traffic": _window("w_traffic", _TRAFFIC),
        "g3_home_detail": _window("w_home_detail", "home_uv_ct, good_detail_uv_ct"),
        "g4_user_login": _window("w_user_login", "back_ct, uu_ct"),
        "g5_user_register": f"""SELECT {stamp()}, register_ct FROM (SELECT {bucket('et')} AS w, count(*) AS register_ct
            FROM ev WHERE event_type = 'signup' GROUP BY ALL)""",
        "g6_cart_add_uu": _window("w_cart_add_uu", "cart_add_uu_ct"),
        "g7_payment_suc": _window("w_payment_suc", "payment_suc_unique_user_count, payment_suc_new_user_count"),
        "g8_order": _window("w_order", "order_unique_user_count, order_new_user_count"),
        "g9_sku_order": f"""SELECT {stamp()}, trademark_id, trademark_name, category1_id, category1_name, category2_id,
            category2_name, category3_id, category3_name, sku_id, sku_name, spu_id, spu_name,
            CAST(original_amount AS DOUBLE) AS original_amount, {_MONEY} FROM w_sku_order""",
        "g10_province_order": f"""SELECT {stamp()}, province_id, province_name, order_count,
            CAST(cents AS DOUBLE) / 100 AS order_amount FROM w_province_order""",
        "g11_refund": _window("w_refund", _REFUND),
        "r1": "SELECT cur_date, ch, CAST(sum(uv_ct) AS BIGINT) AS uv_ct FROM d_traffic WHERE ch IS NOT NULL GROUP BY ALL",
        "r2": "SELECT cur_date, ch, CAST(sum(sv_ct) AS BIGINT) AS sv_ct FROM d_traffic GROUP BY ALL",
        "r3": f"""SELECT cur_date, ch, {two_places("CAST(sum(pv_ct) AS DOUBLE) / nullif(sum(sv_ct), 0)")} AS pv_per_session
            FROM d_traffic GROUP BY ALL""",
        "r4": f"""SELECT cur_date, ch, {two_places("CAST(sum(dur_sum) AS DOUBLE) / nullif(sum(sv_ct), 0) / 1000")} AS dur_per_session
            FROM d_traffic GROUP BY ALL""",
        "r5": """SELECT cur_date, hour(w) AS hr, CAST(sum(uv_ct) AS BIGINT) AS uv_ct, CAST(sum(pv_ct) AS BIGINT) AS pv_ct,
            CAST(sum(CASE WHEN is_new = '1' THEN uv_ct ELSE 0 END) AS BIGINT) AS new_uv_ct FROM d_traffic GROUP BY ALL""",
        "r6": _R6,
        "r6b_pivot": f"""SELECT cur_date, type, max(CASE WHEN is_new = '1' THEN value END) AS new_visitors,
            max(CASE WHEN is_new = '0' THEN value END) AS old_visitors FROM (
            SELECT cur_date, is_new, 'uv_ct' AS type, CAST(uv_ct AS DOUBLE) AS value FROM ({_R6})
            UNION ALL SELECT cur_date, is_new, 'pv_ct', CAST(pv_ct AS DOUBLE) FROM ({_R6})
            UNION ALL SELECT cur_date, is_new, 'avg_dur_sum', avg_dur_sum FROM ({_R6})
            UNION ALL SELECT cur_date, is_new, 'avg_pv_ct', avg_pv_ct FROM ({_R6})) GROUP BY cur_date, type""",
        "r7": """SELECT strftime(w, '%Y-%m-%d') AS cur_date, keyword AS name, CAST(sum(keyword_count) AS BIGINT) AS value
            FROM w_keyword GROUP BY ALL""",
        "r8": _labelled("num", (codes.BACK_USERS, "w_user_login", "back_ct"),
                        (codes.ACTIVE_USERS, "w_user_login", "uu_ct")),
        "r9": _labelled("value", ("home", "w_home_detail", "home_uv_ct"),
                        ("good_detail", "w_home_detail", "good_detail_uv_ct"),
                        ("cart", "w_cart_add_uu", "cart_add_uu_ct"),
                        ("trade", "w_order", "order_unique_user_count"),
                        ("payment", "w_payment_suc", "payment_suc_unique_user_count")),
        "r10": _labelled("num", ("order", "w_order", "order_new_user_count"),
                         ("payment", "w_payment_suc", "payment_suc_new_user_count")),
        "r11": _goods(["trademark_id"], ["trademark_name"]),
        "r12": """SELECT cur_date, trademark_name AS name, CAST(sum(order_amount) AS DOUBLE) AS value
            FROM d_sku GROUP BY cur_date, trademark_id, trademark_name""",
        "r13": _goods([f"category{n}_id" for n in (1, 2, 3)], [f"category{n}_name" for n in (1, 2, 3)]),
        "r14": """SELECT cur_date, spu_name, CAST(sum(order_amount) AS DOUBLE) AS order_amount
            FROM d_sku GROUP BY cur_date, spu_id, spu_name""",
        "r15": "SELECT cur_date, CAST(sum(cents) AS DOUBLE) / 100 AS order_total_amount FROM d_province GROUP BY ALL",
        "r16": _labelled("num", (codes.ORDERS, "w_province_order", "order_count"),
                         (codes.ORDER_USERS, "w_order", "order_unique_user_count"),
                         (codes.REFUNDS, "w_refund", "refund_count"))
        + f""" UNION ALL SELECT cur_date, '{codes.REFUND_USERS}', count(DISTINCT user_id) FROM d_refund GROUP BY cur_date""",
        "r17": """SELECT cur_date, province_name AS name, CAST(sum(order_count) AS BIGINT) AS value
            FROM d_province GROUP BY cur_date, province_id, province_name""",
        "r18": """SELECT cur_date, province_name AS name, CAST(sum(cents) AS DOUBLE) / 100 AS value
            FROM d_province GROUP BY cur_date, province_id, province_name""",
        "r19": f"""SELECT cur_date, {two_places("CAST(sum(activity_reduce_amount) AS DOUBLE) / CAST(sum(original_amount) AS DOUBLE) * 100")} AS rate
            FROM d_sku GROUP BY ALL""",
        "r20": f"""SELECT cur_date, {two_places("CAST(sum(coupon_reduce_amount) AS DOUBLE) / CAST(sum(original_amount) AS DOUBLE) * 100")} AS rate
            FROM d_sku GROUP BY ALL""",
    }
    # A stream run to its end holds what the batch job computes.
    q.update({
        "t4_stream_keyword": q["g1_keyword"],
        "t4_stream_register": q["g5_user_register"],
        "t4_stream_cart_uu": q["g6_cart_add_uu"],
        "t10_stream_interval_join": q["j5_interval_join"],
        # what comes for a window that the batches but the last one have closed is lost
        "t8_stream_late_counts": f"""SELECT * FROM (WITH late AS (SELECT et, event_type, {bucket('et')} AS w,
              least(CAST(seq * 5 // (max(seq) OVER () + 1) AS INT) + CASE WHEN seq % 7 = 3 THEN 2 ELSE 0 END, 4) AS b FROM traf),
            tops AS (SELECT b, max(et) AS top FROM late GROUP BY b),
            marks AS (SELECT k.b, max(t.top) - INTERVAL 30 MINUTES AS mark FROM tops k LEFT JOIN tops t ON t.b <= k.b - 2 GROUP BY k.b),
            judged AS (SELECT late.*, coalesce(w + INTERVAL 5 SECONDS <= mark, false) AS gone FROM late JOIN marks USING (b))
            SELECT 'window' AS kind, strftime(w, {STAMP}) AS stt, event_type, count(*) AS n FROM judged WHERE NOT gone GROUP BY ALL
            UNION ALL SELECT 'lost rows', NULL, NULL, count(*) FILTER (gone) FROM judged
            UNION ALL SELECT 'lost groups', NULL, NULL, count(DISTINCT CASE WHEN gone THEN (w, event_type, b) END) FROM judged)""",
        "s13_stream_text_lines": q["p1_valid_change_log"],
        "s16_stored_r9": q["r9"],
        "s16_stored_r16": q["r16"],
        "f22_report_of_a_day": f"SELECT name, value FROM ({q['r18']}) WHERE cur_date = '1998-03-15'",
        "f22_report_of_today": "SELECT unnest(['order', 'payment']) AS name, CAST(NULL AS BIGINT) AS num",
        "t11_stream_route_as_of": q["t11_route_as_of"],
        "m5_stream_dimension_life": q["m5_dimension_life"],
        "t14_stream_upserts": """SELECT tab AS "table", id, name, ts, seq FROM (SELECT * FROM line_changes
            QUALIFY row_number() OVER (PARTITION BY tab, id ORDER BY ts DESC, seq DESC) = 1) WHERE op_type <> 'delete'""",
        "s10_stream_open_lines": """SELECT id, order_id, sku_id, sku_num, split_total_amount, seq FROM last_lines
            WHERE order_id NOT IN (SELECT order_id FROM cancels)""",
        "w5_stream_first_visit": q["w5_first_visit_fix"],
        "w6_stream_daily_unique": q["w6_daily_unique"],
        "w7_stream_session_first": q["w7_session_first"],
        "w8_stream_backflow": q["w8_backflow"],
        "w9_stream_page_unique": q["w9_page_unique"],
        "w10_stream_first_payment": q["w10_first_payment"],
        "j2_stream_refund_within": _WITHIN["j2"],
        "j4_stream_payment_within": _WITHIN["j4"],
        "t9_stream_traffic": q["g2_traffic"],
        "t9_stream_home_detail": q["g3_home_detail"],
        "t9_stream_user_login": q["g4_user_login"],
        "t12_stream_split_log": " UNION ALL ".join(
            f"SELECT '{kind}' AS kind, seq, {'pos' if kind in ('display', 'action') else 'NULL'} AS pos, mid, ts, is_new FROM ({q['d1_' + kind]})"
            for kind in ("start", "page", "display", "action", "err")),
        "t9_stream_payment": q["g7_payment_suc"],
        "d6_stream_pay_detail": q["d6_pay_detail"],
        "g8_stream_order": q["g8_order"],
        "g9_stream_sku_order": q["g9_sku_order"],
        "g10_stream_province_order": q["g10_province_order"],
        "g11_stream_refund": q["g11_refund"],
        "d4_stream_order_detail": q["d4_order_detail"],
        "d5_stream_cancel_detail": q["d5_cancel_detail"],
        "d7_stream_refund": "SELECT id, order_id, sku_id, province_id, ts, seq FROM refunds",
        "d8_stream_refund_payment": q["j4_refund_fanout"],
        "t11_stream_dimensions": f"SELECT * EXCLUDE (columns) FROM ({q['d0_dimensions']})",
        "s11_stream_routed_facts": f"SELECT * EXCLUDE (columns) FROM ({q['d9_routed_facts']})",
    })
    q["d1_one_pass"] = q["t12_stream_split_log"]
    return q


def oracles() -> dict[str, str]:
    return {name: with_common(body) for name, body in _bodies().items()}
