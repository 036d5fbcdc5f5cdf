"""Data-quality, privacy and record-building queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import text as tx
from kerbline.functions import values
from kerbline.operators import aggregates as agg
from kerbline.operators import privacy, quality, records
from kerbline.plans.registry import query
from kerbline.plans.risk import rounded


@query(
    "reconcile_tolerance",
    """WITH s AS (SELECT o_orderkey, o_totalprice, round(sum(l_extendedprice), 2) AS recomputed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT o_orderkey, o_totalprice, recomputed, CASE WHEN abs(o_totalprice - recomputed) <= greatest(2e-2, abs(o_totalprice) * 5e-3) THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM s""",
)
def reconcile_tolerance(t):
    sums = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("recomputed"))
    j = t.orders.select("o_orderkey", "o_totalprice").join(sums, "o_orderkey")
    return j.withColumn("status", quality.tolerance_status(F.col("o_totalprice"), F.col("recomputed")))


ISSUES = """
j AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, n, qty, tax, first_ship FROM orders LEFT JOIN
  (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS qty, round(max(l_tax), 2) AS tax, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey),
i AS (
 SELECT o_orderkey AS record_id, 'error' AS level, 'lines' AS field, NULL::VARCHAR AS value, 'order has no lines' AS issue FROM j WHERE n IS NULL
 UNION ALL SELECT o_orderkey, 'warning', 'first_ship', o_orderstatus, 'shipped BEFORE the order date' FROM j WHERE first_ship < o_orderdate
 UNION ALL SELECT o_orderkey, 'warning', 'o_orderstatus', o_orderstatus, 'finished order has ' || n || ' lines' FROM j WHERE o_orderstatus = 'F' AND n = 1
 UNION ALL SELECT o_orderkey, 'info', 'o_orderpriority', o_orderpriority, 'priority not specified' FROM j WHERE o_orderpriority LIKE '4%'
 UNION ALL SELECT o_orderkey, 'warning', 'tax', tax::VARCHAR, 'tax outside 0-7%' FROM j WHERE NOT (tax BETWEEN 0 AND 7e-2))"""


def order_issues(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("l_tax"), 2).alias("tax"), F.min("l_shipdate").alias("first_ship")
    )
    j = t.orders.join(lines, "o_orderkey", "left")
    status, n = F.col("o_orderstatus"), F.col("n")
    rules = [
        quality.Rule("error", "lines", n, "order has no lines", n.isNull()),
        quality.Rule("warning", "first_ship", status, "shipped BEFORE the order date", F.col("first_ship") < F.col("o_orderdate")),
        quality.Rule("warning", "o_orderstatus", status, F.concat(F.lit("finished order has "), n.cast("string"), F.lit(" lines")), (status == "F") & (n == 1)),
        quality.Rule("info", "o_orderpriority", F.col("o_orderpriority"), "priority not specified", F.col("o_orderpriority").startswith("4")),
        quality.Rule("warning", "tax", F.col("tax"), "tax outside 0-7%", ~F.col("tax").between(0, 0.07)),
    ]
    return quality.issues(j, "o_orderkey", "orders", rules)


@query("rule_issues", f"WITH {ISSUES} SELECT record_id, 'orders' AS table_name, level, field, value, issue FROM i")
def rule_issues(t):
    return order_issues(t)


@query("issue_rollup", f"WITH {ISSUES} SELECT level, field, count(*) AS n FROM i GROUP BY 1, 2")
def issue_rollup(t):
    return quality.roll_up(order_issues(t), ["level", "field"])


@query(
    "masked_issues",
    f"WITH {ISSUES} SELECT record_id, field, CASE WHEN field IN ('o_orderstatus', 'first_ship') THEN '[removed]' ELSE value END AS value FROM i",
)
def masked_issues(t):
    return privacy.mask_issue_values(order_issues(t), ["o_orderstatus", "first_ship"]).select("record_id", "field", "value")


@query(
    "row_totals",
    """WITH c AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_totalprice > 10000) AS total FROM orders GROUP BY 1)
SELECT o_custkey, f, o, total, f + o <> total AS mismatch FROM c""",
)
def row_totals(t):
    c = t.orders.groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"), F.count_if(F.col("o_totalprice") > 10000).alias("total")
    )
    return c.withColumn("mismatch", quality.total_mismatch(F.col("total"), [F.col("f"), F.col("o")]))


@query(
    "same_multiset",
    """WITH a AS (SELECT l_quantity::BIGINT AS v, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_quantity::BIGINT AS v, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
d AS (SELECT coalesce(a.n, 0) - coalesce(b.n, 0) AS d FROM a FULL JOIN b USING (v))
SELECT coalesce(sum(d) FILTER (WHERE d > 0), 0)::BIGINT AS only_in_first, coalesce(sum(-d) FILTER (WHERE d < 0), 0)::BIGINT AS only_in_second, count(*) FILTER (WHERE d <> 0) = 0 AS equal FROM d""",
)
def same_multiset(t):
    q = lambda f: t.lineitem.filter(F.col("l_returnflag") == f).select(F.col("l_quantity").cast("long"))
    return quality.same_multiset(q("R"), q("A"))


@query(
    "completeness_tiers",
    """WITH j AS (SELECT doc_id, (length(text) >= 500)::INT + (quality IS NOT NULL)::INT + (toxic = 0)::INT + (lang = 'en')::INT AS raw, (length(text) >= 500)::INT + (quality IS NOT NULL)::INT + coalesce((toxic = 0)::INT, 0) + (lang = 'en')::INT AS k FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT CASE WHEN k >= 4 * 8e-1 THEN 'complete' WHEN k >= 4 * 5e-1 THEN 'partial' ELSE 'sparse' END AS tier, count(*) AS n FROM j GROUP BY 1)
SELECT tier, n, round(n / (SELECT sum(n) FROM c), 6) AS share FROM c""",
)
def completeness_tiers(t):
    j = t.documents.join(t.labels, "doc_id", "left")
    usable = [F.length("text") >= 500, F.col("quality").isNotNull(), F.coalesce(F.col("toxic") == 0, F.lit(False)), F.col("lang") == "en"]
    return rounded(agg.value_shares(j.withColumn("tier", quality.completeness_tier(usable)), ["tier"]), 6)


@query(
    "unknown_labels",
    """SELECT role, label, count(*) AS n FROM (SELECT role, lower(regexp_extract(text, '^(\\S+)', 1)) AS label FROM conversations) WHERE NOT coalesce((role = 'user' AND label IN ('the', 'that', 'and')) OR (role = 'assistant' AND label IN ('than', 'the')), false) GROUP BY 1, 2""",
)
def unknown_labels(t):
    rows = t.conversations.select("role", F.lower(F.regexp_extract("text", r"^(\S+)", 1)).alias("label"))
    return quality.unknown_labels(rows, "role", "label", {"user": ["the", "that", "and"], "assistant": ["than", "the"]})


CELLS = r"""
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
c AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN concat_ws(' ', ws[2], ws[3], ws[4]) WHEN doc_id % 3 = 1 THEN concat_ws(' ', ws[2], ws[4]) ELSE concat_ws(' ', ws[4], ws[2], ws[1]) END AS cell FROM w)"""


@query(
    "text_in_source",
    rf"""WITH {CELLS}, p AS (SELECT doc_id, text, cell, list_filter(regexp_split_to_array(cell, '\s+'), lambda x: x <> '') AS v FROM c),
k AS (SELECT doc_id, v, generate_subscripts(w, 1) AS i, unnest(w) AS token FROM (SELECT doc_id, v, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM p)),
h AS (SELECT doc_id, n, i FROM k, (SELECT unnest([1, 2, 3]) AS n) q WHERE n <= len(v) AND contains(token, v[n])),
s2 AS (SELECT a.doc_id, a.i AS start, min(b.i) AS i FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.n = 1 AND b.n = 2 AND b.i > a.i AND b.i < a.i + 40 GROUP BY 1, 2),
s3 AS (SELECT a.doc_id FROM s2 a JOIN h b ON a.doc_id = b.doc_id AND b.n = 3 AND b.i > a.i AND b.i < a.i + 40)
SELECT doc_id, contains(regexp_replace(text, '\s+', '', 'g'), regexp_replace(cell, '\s+', '', 'g')) AS contiguous,
  CASE len(v) WHEN 0 THEN false WHEN 1 THEN doc_id IN (SELECT doc_id FROM h WHERE n = 1) WHEN 2 THEN doc_id IN (SELECT doc_id FROM s2) ELSE doc_id IN (SELECT doc_id FROM s3) END AS in_order FROM p""",
)
def text_in_source(t):
    """Is a value found in its own source text: written together, or its words in order close by?"""
    d = t.documents.withColumn("ws", F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    w = lambda i: F.get("ws", i)
    cell = (
        F.when(F.col("doc_id") % 3 == 0, F.concat_ws(" ", w(1), w(2), w(3)))
        .when(F.col("doc_id") % 3 == 1, F.concat_ws(" ", w(1), w(3)))
        .otherwise(F.concat_ws(" ", w(3), w(1), w(0)))
    )
    d = d.withColumn("cell", cell)
    tight = lambda c: F.regexp_replace(c, r"\s+", "")
    return d.select(
        "doc_id",
        tight("text").contains(tight("cell")).alias("contiguous"),
        tx.contains_in_order(F.col("text"), F.col("cell")).alias("in_order"),
    )


ROADS = "d AS (SELECT doc_id, text, source, CASE WHEN doc_id % 2 = 0 THEN 'NH ' || doc_id % 500 ELSE 'AS 01 AB ' || (1000 + doc_id % 9000) END AS road_number FROM documents)"


def with_road_numbers(t):
    k = F.col("doc_id")
    road = F.when(k % 2 == 0, F.concat(F.lit("NH "), (k % 500).cast("string"))).otherwise(F.concat(F.lit("AS 01 AB "), (1000 + k % 9000).cast("string")))
    return t.documents.select("doc_id", "text", "source", road.alias("road_number"))


def _sql_hit(col: str, kind: str) -> str:
    hit = f"coalesce(regexp_matches({col}, '{privacy.PATTERNS[kind]}'), false)"
    if kind == "plate" and col == "road_number":
        hit = f"({hit} AND NOT regexp_matches({col}, '{privacy.ROAD_NUMBER}'))"
    return hit


@query(
    "pii_scan",
    f"WITH {ROADS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{k}' AS pattern, count(*) FILTER (WHERE {_sql_hit(c, k)}) AS cells FROM d"
        for c in ("text", "source", "road_number")
        for k in privacy.PATTERNS
    ),
)
def pii_scan(t):
    return privacy.pattern_counts(with_road_numbers(t), ["text", "source", "road_number"], ["road_number"])


@query(
    "pii_blanked",
    f"""WITH {ROADS} SELECT doc_id, length(CASE WHEN NOT ({' OR '.join(_sql_hit('text', k) for k in privacy.PATTERNS)}) THEN text END) AS kept_chars,
  CASE WHEN NOT ({' OR '.join(_sql_hit('road_number', k) for k in privacy.PATTERNS)}) THEN road_number END AS road_number FROM d""",
)
def pii_blanked(t):
    clean = privacy.blank_patterns(with_road_numbers(t), ["text", "road_number"], ["road_number"])
    return clean.select("doc_id", F.length("text").cast("long").alias("kept_chars"), "road_number")


@query(
    "rare_identifier_guard",
    f"""WITH ids AS (SELECT DISTINCT upper(trim(v)) AS v FROM (SELECT c_name AS v FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT c_mktsegment FROM customer) u WHERE length(upper(trim(v))) >= 6 AND NOT regexp_matches(upper(trim(v)), '{privacy.PLACEHOLDER}')),
d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'customer#' || lpad((o_custkey)::VARCHAR, 9, '0') ELSE 'free text ' || o_orderkey % 90 END AS note, o_orderpriority FROM orders),
n AS (SELECT upper(trim(note)) AS v, count(*) AS n FROM d GROUP BY 1)
SELECT o_orderkey, CASE WHEN n.n <= 2 AND ids.v IS NOT NULL THEN NULL ELSE note END AS note FROM d JOIN n ON n.v = upper(trim(note)) LEFT JOIN ids ON ids.v = n.v""",
)
def rare_identifier_guard(t):
    known = privacy.known_identifiers(
        {"customer": (t.customer, ["c_name", "c_mktsegment"]), "supplier": (t.supplier, ["s_name"])}
    )
    k = F.col("o_orderkey")
    note = F.when(k % 7 == 0, F.concat(F.lit("customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).otherwise(
        F.concat(F.lit("free text "), (k % 90).cast("string"))
    )
    return privacy.blank_rare_identifiers(t.orders.select("o_orderkey", note.alias("note")), "o_orderkey", ["note"], known)


@query(
    "code_like_guard",
    f"""WITH d AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name || ' ' || (100000 + p_partkey) WHEN p_partkey % 5 = 1 THEN 'T.NO ' || p_partkey WHEN p_partkey % 5 = 2 THEN (p_partkey % 12 + 1) || '/2020' WHEN p_partkey % 5 = 3 THEN 'MA3ERLF1S00' || (100000 + p_partkey % 900000) ELSE p_name END AS body_type FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(body_type, '{privacy.CODE_LIKE}') THEN NULL ELSE body_type END AS body_type FROM d""",
)
def code_like_guard(t):
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    body = (
        F.when(k % 5 == 0, F.concat_ws(" ", "p_name", s(100000 + k)))
        .when(k % 5 == 1, F.concat(F.lit("T.NO "), s(k)))
        .when(k % 5 == 2, F.concat(s(k % 12 + 1), F.lit("/2020")))
        .when(k % 5 == 3, F.concat(F.lit("MA3ERLF1S00"), s(100000 + k % 900000)))
        .otherwise(F.col("p_name"))
    )
    d = t.part.select("p_partkey", body.alias("body_type"))
    return d.withColumn("body_type", F.when(~privacy.code_like(F.col("body_type")), F.col("body_type")))


@query(
    "release_table",
    """WITH m AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('salt' || o_orderkey), o_orderkey) AS n FROM orders)
SELECT 'crash_' || repeat('0', greatest(5 - length(n::VARCHAR), 0)::INT) || n AS release_id, round_even(24 + (o_custkey * 37 % 4000) / 1000.0::DOUBLE + o_orderkey % 7 / 1e5, 3) AS latitude_3dp,
 round_even(90 + (o_custkey * 53 % 6000) / 1000.0::DOUBLE + o_orderkey % 7 / 1e5, 3) AS longitude_3dp, o_orderdate::DATE AS event_date, round_even(o_totalprice / 1000, 0) AS delay_hours,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderdate + to_days((o_orderkey % 9)::INT - 4) >= o_orderdate THEN 'yes' ELSE 'no' END AS insurance_valid,
 lower(o_orderpriority) NOT IN ('5-low', 'none') AS damage_reported FROM orders JOIN m USING (o_orderkey)""",
)
def release_table(t):
    k = F.col("o_orderkey")
    ids = privacy.replace_ids(t.orders, "o_orderkey", "crash_", F.md5(F.concat(F.lit("salt"), k.cast("string"))))
    lat = 24 + (F.col("o_custkey") * 37 % 4000) / 1000.0 + k % 7 / 1e5
    lon = 90 + (F.col("o_custkey") * 53 % 6000) / 1000.0 + k % 7 / 1e5
    until = F.when(k % 11 != 0, F.expr("timestampadd(DAY, CAST(o_orderkey % 9 AS INT) - 4, o_orderdate)"))
    wide = t.orders.join(ids, "o_orderkey").select(
        "*",
        *privacy.generalise(lat, lon, F.col("o_orderdate"), F.col("o_totalprice") / 1000),
        values.valid_on(until, F.col("o_orderdate")).alias("insurance_valid"),
        values.reported(F.col("o_orderpriority"), ["5-low", "none"]).alias("damage_reported"),
    )
    return privacy.allow_list(
        wide, ["release_id", "latitude_3dp", "longitude_3dp", "event_date", "delay_hours", "insurance_valid", "damage_reported"]
    )


@query(
    "release_summary",
    "SELECT count(*) AS rows, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day, count(*) FILTER (WHERE o_orderdate IS NULL) AS without_date FROM orders",
)
def release_summary(t):
    day = F.to_date("o_orderdate")
    return t.orders.agg(
        F.count(F.lit(1)).alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count_if(day.isNull()).alias("without_date")
    )


@query(
    "typed_parse",
    r"""WITH r AS (SELECT o_orderkey,
  CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%d-%b-%Y : %I:%M %p') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(o_orderdate, '%d %b %Y  %I:%M %p') WHEN 3 THEN 'Not Known' ELSE strftime(o_orderdate, '%d-%b-%Y %H:%M:%S') END AS ts_raw,
  CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%d-%b-%Y') WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000') ELSE '31-31-2020' END AS day_raw,
  CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 100)::VARCHAR || ' m' WHEN 1 THEN (o_orderkey % 70)::VARCHAR || '.5 KMPH' WHEN 2 THEN '-' || (o_orderkey % 9) || 'kg' ELSE '12 x 4' END AS num_raw,
  'Lat : ' || (20 + o_orderkey % 9) || '.25 Lon : -' || (o_orderkey % 90) || CASE WHEN o_orderkey % 2 = 0 THEN '.5' ELSE '' END AS pos_raw, (o_orderkey % 15) || '/' || (2000 + o_orderkey % 20) AS my_raw FROM orders)
SELECT o_orderkey, date_trunc('minute', coalesce(try_strptime(ts, '%d-%b-%Y : %I:%M %p'), try_strptime(ts, '%Y-%m-%d %H:%M:%S'), try_strptime(ts, '%d %b %Y %I:%M %p'), try_strptime(ts, '%d-%b-%Y %H:%M:%S'))) AS ts,
  coalesce(try_strptime(day_raw, '%d-%b-%Y'), try_strptime(day_raw, '%d-%m-%Y'), try_strptime(day_raw, '%Y-%m-%d'), try_strptime(day_raw, '%d/%m/%Y'), try_strptime(substr(day_raw, 1, 19), '%Y-%m-%dT%H:%M:%S'))::DATE AS day,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 100 WHEN o_orderkey % 4 = 1 THEN o_orderkey % 70 + 5e-1 WHEN o_orderkey % 4 = 2 THEN -(o_orderkey % 9) END::DOUBLE AS number,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 100 WHEN o_orderkey % 4 = 2 THEN -(o_orderkey % 9) END::BIGINT AS whole,
  (20 + o_orderkey % 9 + 25e-2)::DOUBLE AS lat, -(o_orderkey % 90 + CASE WHEN o_orderkey % 2 = 0 THEN 5e-1 ELSE 0 END)::DOUBLE AS lon,
  CASE WHEN o_orderkey % 15 BETWEEN 1 AND 12 THEN 2000 + o_orderkey % 20 END::INT AS year, CASE WHEN o_orderkey % 15 BETWEEN 1 AND 12 THEN o_orderkey % 15 END::INT AS month
FROM (SELECT *, regexp_replace(ts_raw, '\s+', ' ', 'g') AS ts FROM r)""",
)
def typed_parse(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    s = lambda c: c.cast("string")
    fmt = F.date_format
    ts_raw = (
        F.when(k % 5 == 0, fmt(d, "dd-MMM-yyyy : hh:mm a")).when(k % 5 == 1, fmt(d, "yyyy-MM-dd HH:mm:ss"))
        .when(k % 5 == 2, fmt(d, "dd MMM yyyy  hh:mm a")).when(k % 5 == 3, "Not Known").otherwise(fmt(d, "dd-MMM-yyyy HH:mm:ss"))
    )
    day_raw = (
        F.when(k % 6 == 0, fmt(d, "dd-MMM-yyyy")).when(k % 6 == 1, fmt(d, "dd-MM-yyyy")).when(k % 6 == 2, fmt(d, "yyyy-MM-dd"))
        .when(k % 6 == 3, fmt(d, "dd/MM/yyyy")).when(k % 6 == 4, fmt(d, "yyyy-MM-dd'T'HH:mm:ss.SSS")).otherwise("31-31-2020")
    )
    num_raw = (
        F.when(k % 4 == 0, F.concat(s(k % 100), F.lit(" m"))).when(k % 4 == 1, F.concat(s(k % 70), F.lit(".5 KMPH")))
        .when(k % 4 == 2, F.concat(F.lit("-"), s(k % 9), F.lit("kg"))).otherwise("12 x 4")
    )
    pos_raw = F.concat(F.lit("Lat : "), s(20 + k % 9), F.lit(".25 Lon : -"), s(k % 90), F.when(k % 2 == 0, ".5").otherwise(""))
    my_raw = F.concat(s(k % 15), F.lit("/"), s(2000 + k % 20))
    lat, lon = tx.parse_lat_lon(pos_raw)
    year, month = tx.parse_month_year(my_raw)
    return t.orders.select(
        "o_orderkey",
        F.date_trunc("minute", tx.parse_timestamp(ts_raw)).cast("timestamp_ntz").alias("ts"),
        tx.parse_date(day_raw).alias("day"),
        tx.parse_number(num_raw).alias("number"),
        tx.parse_integer(num_raw).alias("whole"),
        lat.alias("lat"), lon.alias("lon"), year.alias("year"), month.alias("month"),
    )


@query(
    "text_cleaning",
    r"""SELECT doc_id, length(trim(regexp_replace(text, '[\s]+', ' ', 'g'))) AS clean_chars, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'Not Known' ELSE source END AS value,
  CASE WHEN doc_id % 2 = 0 THEN source END AS left_key, CASE WHEN doc_id % 2 = 0 THEN lang END AS right_key, split_part('in/2023/5/accid' || doc_id || '.pdf', '/', 2) AS folder_year, '5' AS folder_month, doc_id::VARCHAR AS file_id FROM documents""",
)
def text_cleaning(t):
    k = F.col("doc_id")
    raw = F.when(k % 4 == 0, " n/a ").when(k % 4 == 1, "Not \t Known").otherwise(F.concat(F.lit("  "), F.col("source")))
    head = F.when(k % 2 == 0, F.concat_ws(" | ", "source", "lang")).otherwise(F.col("source"))
    left, right = tx.split_heading(head)
    path = tx.path_parts(F.concat(F.lit("in/2023/5/accid"), k.cast("string"), F.lit(".pdf")))
    return t.documents.select(
        "doc_id",
        F.length(tx.clean_label(F.col("text"))).cast("long").alias("clean_chars"),
        tx.clean_value(raw).alias("value"),
        left.alias("left_key"),
        right.alias("right_key"),
        *[c.alias(n) for n, c in path.items()],
    )


TURNS = """r AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS record_no, last_value(CASE WHEN role <> 'assistant' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations)"""


@query(
    "segment_records",
    f"WITH {TURNS} SELECT conv_id, record_no::BIGINT AS record_no, count(*) AS rows, min(turn) AS first_turn, max(turn) AS last_turn, sum(length(text))::BIGINT AS chars FROM r GROUP BY 1, 2",
)
def segment_records(t):
    """A new record starts at every user turn."""
    r = records.number_records(t.conversations, "conv_id", ["turn"], F.col("role") == "user")
    return r.groupBy("conv_id", "record_no").agg(
        F.count(F.lit(1)).alias("rows"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars")
    )


@query(
    "carried_sections",
    f"WITH {TURNS} SELECT conv_id, turn, role, section FROM r",
)
def carried_sections(t):
    heading = F.when(F.col("role") != "assistant", F.col("role"))
    rows = t.conversations.select("conv_id", "turn", "role", heading.alias("heading"))
    return records.carry_section(rows, "conv_id", ["turn"], "heading").select("conv_id", "turn", "role", "section")


@query(
    "continuation_text",
    f"WITH {TURNS} SELECT conv_id, record_no::BIGINT AS record_no, sha256(string_agg(text, ' ' ORDER BY turn)) AS value_hash FROM r GROUP BY 1, 2",
)
def continuation_text(t):
    """Turns after the first one of a record continue its text."""
    r = records.number_records(t.conversations, "conv_id", ["turn"], F.col("role") == "user")
    joined = records.join_continuations(r, ["conv_id", "record_no"], "turn", "text")
    return joined.select("conv_id", "record_no", F.sha2("text", 256).alias("value_hash"))


@query(
    "record_sequence",
    f"WITH {TURNS} SELECT conv_id, section, turn, row_number() OVER (PARTITION BY conv_id, section ORDER BY turn) AS record_seq FROM r WHERE section IS NOT NULL",
)
def record_sequence(t):
    from kerbline.session import cut_lineage

    rows = t.conversations.select("conv_id", "turn", F.when(F.col("role") != "assistant", F.col("role")).alias("heading"))
    carried = cut_lineage(records.carry_section(rows, "conv_id", ["turn"], "heading").filter(F.col("section").isNotNull()))
    return records.record_sequence(carried, "conv_id", "section", ["turn"]).select("conv_id", "section", "turn", "record_seq")


@query(
    "records_at_repeats",
    """WITH RECURSIVE e AS (SELECT user_id, event_id AS pos, CASE WHEN event_type = 'signup' THEN event_type END AS heading, CASE WHEN event_type <> 'signup' THEN event_type END AS label FROM events),
b AS (SELECT *, sum((heading IS NOT NULL)::INT) OVER (PARTITION BY user_id ORDER BY pos) AS block, last_value(heading IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos) AS record_heading FROM e),
d AS (SELECT user_id, pos, block, record_heading, label, row_number() OVER (PARTITION BY user_id, block ORDER BY pos) AS rn FROM b WHERE label IS NOT NULL),
r AS (SELECT user_id, block, rn, [label] AS seen, 1 AS n FROM d WHERE rn = 1
  UNION ALL SELECT d.user_id, d.block, d.rn, CASE WHEN list_contains(seen, label) THEN [label] ELSE list_append(seen, label) END, CASE WHEN list_contains(seen, label) THEN n + 1 ELSE n END
  FROM r JOIN d ON d.user_id = r.user_id AND d.block = r.block AND d.rn = r.rn + 1)
SELECT user_id, block::BIGINT AS block, record_heading, pos, n AS record_in_block FROM r JOIN d USING (user_id, block, rn)""",
)
def records_at_repeats(t):
    rows = t.events.select(
        "user_id",
        F.col("event_id").alias("pos"),
        F.when(F.col("event_type") == "signup", F.col("event_type")).alias("heading"),
        F.when(F.col("event_type") != "signup", F.col("event_type")).alias("label"),
    )
    return records.cut_at_repeats(rows, "user_id", "pos", "heading", "label")


@query(
    "widened_records",
    """SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS last_click, max(CASE WHEN event_type = 'purchase' THEN value END) AS last_purchase FROM events GROUP BY 1""",
)
def widened_records(t):
    return records.widen(t.events, ["user_id"], "event_type", "value", {"click": "last_click", "purchase": "last_purchase"})
