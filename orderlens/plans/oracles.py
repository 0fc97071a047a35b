"""Independent SQL for the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from orderlens.operators import ingest
from orderlens.plans import registry
from orderlens.plans.canon import AS_OF, SQL
from orderlens.sources.tables import TABLES

_D = f"DATE '{AS_OF}'"


def _canon(text: str) -> str:
    return f"WITH {SQL}{', ' if text.lstrip().startswith('+') else ''}{text.lstrip().removeprefix('+')}"


_RFM = f"""+ b AS (SELECT customer_id, {_D} - max(order_date) AS recency, count(*) AS frequency, sum(net) AS monetary FROM sold GROUP BY customer_id),
t AS (SELECT *, ntile(5) OVER (ORDER BY recency DESC, customer_id) AS r, ntile(5) OVER (ORDER BY frequency, customer_id) AS f, ntile(5) OVER (ORDER BY monetary, customer_id) AS m FROM b),
g AS (SELECT customer_id, recency::INT AS recency, frequency, round(monetary::DOUBLE, 4) AS monetary, r || '' || f || '' || m AS rfm_score,
CASE WHEN r >= 4 AND f >= 4 AND m = 5 THEN 'Champions' WHEN r >= 3 AND f >= 4 THEN 'Loyal Customers' WHEN r <= 2 AND f >= 3 THEN 'At Risk' WHEN r >= 4 AND f <= 2 THEN 'New Customers' WHEN r <= 2 AND f <= 2 THEN 'Hibernating' ELSE 'Potential' END AS rfm_segment FROM t)
"""


def _segments(day: str, name: str) -> str:
    """seg_name: the segments of the customers known before a day, ranked among themselves."""
    ranked = _RFM.lstrip("+ ").replace(_D, f"DATE '{day}'").replace("FROM sold", f"FROM sold WHERE order_date < DATE '{day}'")
    for x in ("b", "t", "g"):
        ranked = ranked.replace(f"{x} AS (SELECT", f"{x}_{name} AS (SELECT").replace(f"FROM {x})", f"FROM {x}_{name})")
    return f"{ranked}, seg_{name} AS (SELECT customer_id, rfm_segment AS segment, DATE '{day}' AS day FROM g_{name})"


_HISTORY = "+" + ",".join(_segments(d, f"y{i}") for i, d in enumerate(registry.YEARS)) + ", snap AS (" + " UNION ALL ".join(f"SELECT * FROM seg_y{i}" for i in range(len(registry.YEARS))) + """),
turn AS (SELECT * FROM (SELECT *, lag(segment) OVER (PARTITION BY customer_id ORDER BY day) AS past FROM snap) WHERE segment IS DISTINCT FROM past),
hist AS (SELECT customer_id, segment, day AS valid_from, lead(day) OVER (PARTITION BY customer_id ORDER BY day) AS valid_to FROM turn)
"""
_COHORT = """+ f AS (SELECT customer_id, date_trunc('month', min(order_date))::DATE AS cohort_month FROM sold GROUP BY 1), z AS (SELECT cohort_month, count(*) AS size FROM f GROUP BY 1),
k AS (SELECT cohort_month, datediff('month', cohort_month, date_trunc('month', order_date)) AS months_since, count(DISTINCT customer_id) AS customers FROM sold JOIN f USING (customer_id) GROUP BY 1, 2),
h AS (SELECT cohort_month, months_since::INT AS months_since, customers, round(customers / size, 6) AS retention FROM k JOIN z USING (cohort_month))
"""


def _revenue(grain: str) -> str:
    return _canon(f"""+ p AS (SELECT date_trunc('{grain}', order_date)::DATE AS period, sum(net)::DOUBLE AS n, count(*) AS orders FROM sold GROUP BY 1)
SELECT period, round(n, 4) AS revenue, orders, round(n / orders, 8) AS aov, round((n - lag(n) OVER (ORDER BY period)) / lag(n) OVER (ORDER BY period), 6) AS growth FROM p""")


_KPI = """+ days AS (SELECT unnest(generate_series(min(order_date)::TIMESTAMP, max(order_date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM sold),
b AS (SELECT order_date AS day, sum(net) AS n, count(*) AS orders FROM sold GROUP BY 1), w AS (SELECT day, count(*) AS new FROM (SELECT min(order_date) AS day FROM sold GROUP BY customer_id) GROUP BY 1),
kpi AS (SELECT day, round(coalesce(n, 0)::DOUBLE, 4) AS revenue, coalesce(orders, 0) AS orders, round(n::DOUBLE / orders, 8) AS aov, coalesce(new, 0) AS new_customers FROM days LEFT JOIN b USING (day) LEFT JOIN w USING (day))
"""
_PROFILE = f"""+ prof AS (SELECT customer_id, count(*) AS total_orders, sum(net) AS lifetime_value, min(order_date) AS first_purchase_date, max(order_date) AS last_order_date, sum(CASE WHEN {_D} - order_date <= 365 THEN net END) AS arr, {_D} - max(order_date) AS recency FROM sold GROUP BY 1)
"""
_ABC = f"""+ v AS (SELECT product_id, sum(line_total) AS revenue FROM sitems GROUP BY 1), s AS (SELECT *, coalesce(sum(revenue) OVER (ORDER BY revenue DESC, product_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / (sum(revenue) OVER ())::DOUBLE AS share FROM v),
abc AS (SELECT product_id, round(revenue::DOUBLE, 4) AS revenue, round(share, 6) AS share_before, CASE WHEN share < 0.2 THEN 'A' WHEN share < 0.5 THEN 'B' ELSE 'C' END AS abc_tier, {_D} AS abc_computed_at FROM s)
"""


def _forecast(key: str = "'all'") -> str:
    return f"""+ raw AS (SELECT {key} AS k, order_date AS ds, sum(net)::DOUBLE AS y FROM sold GROUP BY 1, 2), span AS (SELECT k, unnest(generate_series(min(ds)::TIMESTAMP, max(ds)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS ds FROM raw GROUP BY 1),
ser AS (SELECT span.k, span.ds, coalesce(y, 0) AS y, (span.ds - DATE '1970-01-01')::DOUBLE AS x FROM span LEFT JOIN raw ON raw.k = span.k AND raw.ds = span.ds),
fit AS (SELECT k, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS mean, count(*) AS n, max(ds) AS last FROM ser GROUP BY 1),
his AS (SELECT ser.*, n, CASE WHEN n >= 14 THEN a + b * x ELSE mean END AS t, dayofweek(ds) AS wd FROM ser JOIN fit USING (k)), eff AS (SELECT k, wd, CASE WHEN max(n) >= 14 THEN avg(y - t) ELSE 0 END AS e FROM his GROUP BY 1, 2),
seen AS (SELECT his.k, ds, y, t + e AS f FROM his JOIN eff ON his.k = eff.k AND his.wd = eff.wd), sd AS (SELECT k, coalesce(stddev_samp(y - f), 0) AS sd FROM seen GROUP BY 1),
fut AS (SELECT k, (last + i::INT) AS ds, CASE WHEN n >= 14 THEN a + b * (last + i::INT - DATE '1970-01-01') ELSE mean END AS t FROM fit, range(1, 31) r(i)),
al AS (SELECT k, ds, y, f, TRUE AS is_historical FROM seen UNION ALL SELECT fut.k, ds, NULL, t + coalesce(e, 0), FALSE FROM fut LEFT JOIN eff ON fut.k = eff.k AND dayofweek(fut.ds) = eff.wd),
fc AS (SELECT k, ds, round(y, 4) AS actual, round(greatest(f, 0), 2) AS yhat, round(greatest(f - 1.96 * sd, 0), 2) AS yhat_lower, round(greatest(f + 1.96 * sd, 0), 2) AS yhat_upper, is_historical FROM al JOIN sd USING (k))
"""


_POLARITY = r"""inc AS (SELECT DISTINCT conv_id, turn, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS word FROM conversations), held AS (SELECT word, count(*) AS n FROM inc WHERE word <> '' GROUP BY 1 HAVING count(*) >= 2),
i AS (SELECT conv_id, turn, word, ln((SELECT count(*) FROM conversations) / n) AS idf FROM inc JOIN held USING (word)), rated AS (SELECT doc_id, text, quality = 1 AND toxic = 0 AS good FROM documents JOIN labels USING (doc_id)),
rw AS (SELECT DISTINCT doc_id, good, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS word FROM rated), rc AS (SELECT word, count(*) FILTER (good) AS g, count(*) FILTER (NOT good) AS b FROM rw GROUP BY 1),
od AS (SELECT word, round(ln((g + 0.5) / ((SELECT count(*) FROM rated WHERE good) - g + 0.5)) - ln((b + 0.5) / ((SELECT count(*) FROM rated WHERE NOT good) - b + 0.5)), 9) AS odds FROM rc JOIN held USING (word) WHERE n >= 3),
seed AS (SELECT word, 1.0::DOUBLE AS weight FROM (SELECT * FROM od WHERE odds > 0 ORDER BY odds DESC, word LIMIT 20) UNION ALL SELECT word, -1.0 FROM (SELECT * FROM od WHERE odds < 0 ORDER BY odds, word LIMIT 20)),
p0 AS (SELECT word, coalesce(weight, 0) AS p, weight IS NOT NULL AS is_seed FROM held LEFT JOIN seed USING (word)),
""" + ",\n".join(f"""s{k} AS (SELECT conv_id, turn, CASE WHEN sum(idf) <> 0 THEN sum(idf * p) / sum(idf) END AS s FROM i JOIN p{k} USING (word) GROUP BY 1, 2),
m{k} AS (SELECT word, avg(s) AS s FROM i JOIN s{k} USING (conv_id, turn) GROUP BY 1), p{k + 1} AS (SELECT word, CASE WHEN is_seed THEN p ELSE coalesce(s, 0) END AS p, is_seed FROM p{k} LEFT JOIN m{k} USING (word))""" for k in range(3)) + """,
s3 AS (SELECT conv_id, turn, CASE WHEN sum(idf) <> 0 THEN sum(idf * p) / sum(idf) END AS s FROM i JOIN p3 USING (word) GROUP BY 1, 2),
z AS (SELECT conv_id, turn, s IS NULL AS none, round(coalesce((s - (SELECT avg(s) FROM s3)) / (SELECT stddev_pop(s) FROM s3), 0), 6) AS z FROM conversations LEFT JOIN s3 USING (conv_id, turn)),
sc AS (SELECT conv_id, turn, CASE WHEN z >= 0.5 THEN 'POSITIVE' WHEN z <= -0.5 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment_label, round(CASE WHEN none THEN 0 WHEN abs(z) >= 0.5 THEN 1 - exp(-abs(z)) ELSE exp(-abs(z)) END, 4) AS sentiment_score FROM z)
"""
_CHAIN = """+ a AS (SELECT order_id AS k, order_date, CASE WHEN order_id % 7 <> 0 THEN total::DECIMAL(14,2) END AS amount, CASE WHEN order_id % 11 = 0 THEN 'lost' ELSE status END AS status FROM ord),
r AS (SELECT *, 0 AS batch_id, false AS more FROM a UNION ALL SELECT k, order_date, amount + 1, status, 0, true FROM a WHERE k % 17 = 0 AND k % 7 > 1 UNION ALL SELECT *, 1, false FROM a WHERE k % 2 = 0),
q AS (SELECT *, concat_ws(',', CASE WHEN amount IS NULL THEN 'amount' END, CASE WHEN status = 'lost' THEN 'status' END, CASE WHEN k % 13 = 0 THEN 'key' END) AS failed FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY k, failed ORDER BY batch_id, amount DESC) AS place FROM q),
chain AS (SELECT CASE WHEN k % 13 <> 0 THEN k::VARCHAR END AS external_id, CASE WHEN failed = '' AND place = 1 THEN 'accepted' ELSE 'rejected' END AS outcome, CASE WHEN failed <> '' THEN failed WHEN place > 1 THEN 'duplicate' ELSE '' END AS reasons,
order_date, amount::DOUBLE AS total_amount, 'USD' AS currency, status, batch_id::BIGINT AS batch_id FROM p)
"""
_SENT = "lex(word, weight) AS (VALUES " + ", ".join(f"('{w}', {n})" for w, n in registry.LEXICON) + """),
wd AS (SELECT conv_id, turn, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS word FROM conversations), hit AS (SELECT conv_id, turn, count(*) FILTER (weight > 0) AS p, count(*) FILTER (weight < 0) AS n FROM wd LEFT JOIN lex USING (word) GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN p + n > 0 THEN (p - n)::DOUBLE / (p + n) END AS s FROM hit),
sc AS (SELECT conv_id, turn, CASE WHEN s >= 0.2 THEN 'POSITIVE' WHEN s <= -0.2 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment_label, round(CASE WHEN s IS NULL THEN 0 WHEN abs(s) >= 0.2 THEN abs(s) ELSE 1 - abs(s) END, 4) AS sentiment_score FROM q)
"""


def _margin(by: str) -> str:
    return _canon(f"SELECT {by}, round(sum(line_total - line_discount)::DOUBLE, 4) AS net, round((sum(line_total - line_discount) - sum(line_cost))::DOUBLE, 4) AS gross_margin, round(((sum(line_total - line_discount) - sum(line_cost)) * 100)::DOUBLE / sum(line_total - line_discount)::DOUBLE, 4) AS gross_margin_pct FROM sitems GROUP BY 1")


def _returns(by: str) -> str:
    return _canon(f"SELECT {by}, count(DISTINCT order_id) AS orders, count(DISTINCT CASE WHEN returned THEN order_id END) AS returned_orders, round(count(DISTINCT CASE WHEN returned THEN order_id END) * 100.0::DOUBLE / count(DISTINCT order_id), 4) AS return_rate FROM items GROUP BY 1")


_STEPS = """WITH e AS (SELECT user_id, event_type, ts FROM events), s1 AS (SELECT user_id, min(ts) AS t0, min(ts) AS t FROM e WHERE event_type = 'view' GROUP BY 1),
s2 AS (SELECT s1.user_id, t0, min(ts) AS t FROM s1 JOIN e ON e.user_id = s1.user_id AND event_type = 'click' AND ts > s1.t AND ts <= t0 + INTERVAL 7 DAY GROUP BY 1, 2),
s3 AS (SELECT s2.user_id, t0, min(ts) AS t FROM s2 JOIN e ON e.user_id = s2.user_id AND event_type = 'signup' AND ts > s2.t AND ts <= t0 + INTERVAL 7 DAY GROUP BY 1, 2),
s4 AS (SELECT s3.user_id, t0, min(ts) AS t FROM s3 JOIN e ON e.user_id = s3.user_id AND event_type = 'purchase' AND ts > s3.t AND ts <= t0 + INTERVAL 7 DAY GROUP BY 1, 2),
u AS (SELECT 1 AS step, 'view' AS event_type, count(*) AS users FROM s1 UNION ALL SELECT 2, 'click', count(*) FROM s2 UNION ALL SELECT 3, 'signup', count(*) FROM s3 UNION ALL SELECT 4, 'purchase', count(*) FROM s4)
SELECT step, event_type, users, round(users / nullif(lag(users) OVER (ORDER BY step), 0), 6) AS step_conversion, round(users / nullif(first_value(users) OVER (ORDER BY step), 0), 6) AS total_conversion FROM u"""

_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::DOUBLE, {b}::DOUBLE), 6) AS r FROM items" for i, a in enumerate(("quantity", "line_total", "line_discount", "line_cost")) for b in ("quantity", "line_total", "line_discount", "line_cost")[i + 1 :])

_HEAD = "hd AS (SELECT customer_id AS upload_job_id, unnest([" + ", ".join(f"'{h}'" for h in registry.HEADERS) + "]) AS csv_header FROM cust), " + (
    "nm AS (SELECT h AS csv_header, array_to_string(list_transform(string_split(trim(regexp_replace(lower(h), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: CASE w "
    + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ingest.ABBREVIATIONS.items())
    + " ELSE w END), ' ') AS norm FROM (SELECT DISTINCT csv_header AS h FROM hd)), "
)
_DICT = "dc(mapped_table, mapped_column, alias) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in registry.ALIASES) + "), "
_SYN = "sy(mapped_table, mapped_column, tokens) AS (VALUES " + ", ".join(f"('{a}', '{b}', [{', '.join(repr(t) for t in c)}])" for a, b, c in registry.SYNONYMS) + "), "
_MAPS = (
    "+" + _HEAD + _DICT + _SYN
    + """ex AS (SELECT csv_header, mapped_table, mapped_column, 1.0::DOUBLE AS match_score, 'exact' AS match_method FROM nm JOIN dc ON norm = alias QUALIFY row_number() OVER (PARTITION BY csv_header ORDER BY mapped_table, mapped_column) = 1),
fz AS (SELECT csv_header, mapped_table, mapped_column, round(1 - levenshtein(norm, alias)::DOUBLE / greatest(length(norm), length(alias), 1), 4) AS match_score, 'fuzzy' AS match_method FROM nm, dc QUALIFY row_number() OVER (PARTITION BY csv_header ORDER BY 1 - levenshtein(norm, alias)::DOUBLE / greatest(length(norm), length(alias), 1) DESC, alias DESC) = 1),
se AS (SELECT csv_header, mapped_table, mapped_column, round(len(list_intersect(list_distinct(string_split(norm, ' ')), tokens))::DOUBLE / len(list_distinct(list_concat(string_split(norm, ' '), tokens))), 4) AS match_score, 'semantic' AS match_method FROM nm, sy WHERE len(list_intersect(string_split(norm, ' '), tokens)) > 0 QUALIFY row_number() OVER (PARTITION BY csv_header ORDER BY match_score DESC, mapped_table, mapped_column) = 1),
hi AS (SELECT 'Colour' AS csv_header, 'products' AS mapped_table, CASE WHEN status = 'pending' THEN 'category' ELSE 'name' END AS mapped_column, 1.0::DOUBLE AS match_score, 'historical' AS match_method FROM ord QUALIFY row_number() OVER (ORDER BY order_date DESC, mapped_column DESC) = 1 UNION ALL SELECT 'Qty', 'order_items', 'quantity', 1.0, 'historical')
"""
)

_UPLOADS = "uv AS (" + " UNION ALL ".join(
    f"SELECT {j} AS upload_job_id, '{h}' AS csv_header, trim({x}::VARCHAR) AS value FROM ord JOIN (SELECT customer_id, email FROM cust) USING (customer_id) WHERE order_id % 2 = 1 AND (order_id // 2) % 3 = {j}"
    for j, own in enumerate(registry.UPLOADS) for h, x in zip(own, ("order_id", "order_date", "total::DECIMAL(14,2)", "email", "country"))
) + "), tv AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS mapped_table, '{m}' AS mapped_column, trim(({x})::VARCHAR) AS value FROM {f}"
    for t, m, x, f in (
        ("orders", "external_id", "order_id", "ord WHERE order_id % 2 = 0"), ("orders", "order_date", "order_date", "ord WHERE order_id % 2 = 0"), ("orders", "total_amount", "total::DECIMAL(14,2)", "ord WHERE order_id % 2 = 0"),
        ("customers", "email", "email", "cust"), ("customers", "country", "country", "cust"), ("customers", "full_name", "full_name", "cust"),
        ("products", "sku", "sku", "prod"), ("products", "name", "name", "prod"), ("products", "category", "category", "prod"), ("order_items", "quantity", "quantity", "items"),
    )
) + "), "


def _profile(rows: str, by: str, tag: str) -> str:
    """kd, sh and sk of a table of values: kinds, shapes and sketches."""
    share = lambda p: f"avg(regexp_matches(value, '{p}')::INT)"
    return f"""kd{tag} AS (SELECT {by}, {share(r'^-?[0-9]+(\.[0-9]+)?$')} AS k1, {share('^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{2}/[0-9]{2}/[0-9]{4}$')} AS k2, {share('[A-Za-z]')} AS k3, {share('@')} AS k4, {share(' ')} AS k5, avg(length(value)) / (avg(length(value)) + 10) AS k6 FROM {rows} WHERE value <> '' GROUP BY ALL),
sp{tag} AS (SELECT {by}, '^' || regexp_replace(regexp_replace(value, '[0-9]', '9', 'g'), '[A-Za-z]', 'a', 'g') || '$' AS shape FROM {rows} WHERE value <> ''),
gr{tag} AS (SELECT {by}, gram, count(*)::DOUBLE AS n FROM (SELECT {by}, unnest(list_transform(range(1, length(shape)), lambda i: substr(shape, i, 2))) AS gram FROM sp{tag}) GROUP BY ALL),
sh{tag} AS (SELECT {by}, gram, n / sqrt(sum(n * n) OVER (PARTITION BY {by})) AS f FROM gr{tag}),
sk{tag} AS (SELECT * FROM (SELECT DISTINCT {by}, md5(value) AS digest FROM {rows} WHERE value <> '') QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY digest) <= 64)"""


_BOTH = "upload_job_id, csv_header, mapped_table, mapped_column"
_VALUES = _UPLOADS + _profile("uv", "upload_job_id, csv_header", "_u") + "," + _profile("tv", "mapped_table, mapped_column", "_t") + f""",
pa AS (SELECT {_BOTH}, 1 - ({' + '.join(f'abs(u.k{i} - t.k{i})' for i in range(1, 7))}) / 6 AS kinds FROM kd_u u, kd_t t), co AS (SELECT {_BOTH}, sum(u.f * t.f) AS shapes FROM sh_u u JOIN sh_t t USING (gram) GROUP BY ALL),
ei AS (SELECT {_BOTH}, digest, 1 AS side FROM pa JOIN sk_u USING (upload_job_id, csv_header) UNION ALL SELECT {_BOTH}, digest, 2 FROM pa JOIN sk_t USING (mapped_table, mapped_column)),
bo AS (SELECT {_BOTH}, digest, sum(side) AS sides FROM ei GROUP BY {_BOTH}, digest QUALIFY row_number() OVER (PARTITION BY {_BOTH} ORDER BY digest) <= 64), cm AS (SELECT {_BOTH}, count(*) FILTER (sides = 3) / count(*) AS common FROM bo GROUP BY ALL),
va AS (SELECT {_BOTH}, round(0.4 * coalesce(shapes, 0) + 0.4 * kinds + 0.2 * coalesce(common, 0), 4) AS match_score, 'values' AS match_method FROM pa LEFT JOIN co USING ({_BOTH}) LEFT JOIN cm USING ({_BOTH}) QUALIFY row_number() OVER (PARTITION BY upload_job_id, csv_header ORDER BY match_score DESC, mapped_table, mapped_column) = 1)
"""
_DIRTY = """+ di AS (SELECT order_id AS k, order_id % 97 AS upload_job_id, order_id::VARCHAR AS external_id, order_date, total::DECIMAL(14,2) AS total, status AS st FROM ord),
cl AS (SELECT k, upload_job_id, external_id, order_date, CASE WHEN k % 7 = 0 THEN NULL ELSE total END AS total_amount, CASE WHEN k % 11 = 0 THEN 'lost' ELSE st END AS status FROM di),
mk AS (SELECT *, list_filter([CASE WHEN total_amount IS NULL THEN 'amount' END, CASE WHEN status = 'lost' THEN 'status' END], lambda x: x IS NOT NULL) AS reasons FROM cl)
"""


def oracle_sql() -> dict[str, str]:
    c = _canon
    return {
        "a01_rfm": c(_RFM + "SELECT * FROM g"),
        "a01_rfm_segments": c(_RFM + "SELECT rfm_segment, count(*) AS customers, round(sum(monetary), 4) AS monetary FROM g GROUP BY 1"),
        "a02_cohort": c(_COHORT + "SELECT * FROM h"),
        "a02_cohort_matrix": c(_COHORT + "SELECT cohort_month, " + ", ".join(f"max(CASE WHEN months_since = {i} THEN retention END) AS m{i}" for i in range(12)) + " FROM h WHERE months_since < 12 GROUP BY 1"),
        "a03_revenue_month": _revenue("month"),
        "a03_revenue_week": _revenue("week"),
        "a04_basket_pairs": c("""+ d AS (SELECT DISTINCT order_id, product_id FROM items), k AS (SELECT product_id, count(*) AS n FROM d GROUP BY 1 HAVING count(*) >= 2), o AS (SELECT count(DISTINCT order_id) AS orders FROM items),
p AS (SELECT x.product_id AS a, y.product_id AS b, count(*) AS support FROM d x JOIN d y ON x.order_id = y.order_id AND x.product_id < y.product_id GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT a, b, support, round(support / ka.n, 6) AS confidence, round(support::DOUBLE * orders / (ka.n * kb.n), 6) AS lift FROM p JOIN k ka ON ka.product_id = a JOIN k kb ON kb.product_id = b, o"""),
        "a04_itemsets": c("""+ d AS (SELECT DISTINCT order_id, product_id AS p FROM items), lim AS (SELECT ceil(0.002 * count(DISTINCT order_id)) AS k FROM items), f AS (SELECT d.* FROM d JOIN (SELECT p FROM d GROUP BY 1 HAVING count(*) >= (SELECT k FROM lim)) USING (p)),
x AS (SELECT p::VARCHAR AS items, count(*) AS support FROM f GROUP BY 1 UNION ALL SELECT a.p || ',' || b.p, count(*) FROM f a JOIN f b ON a.order_id = b.order_id AND a.p < b.p GROUP BY 1
UNION ALL SELECT a.p || ',' || b.p || ',' || e.p, count(*) FROM f a JOIN f b ON a.order_id = b.order_id AND a.p < b.p JOIN f e ON e.order_id = a.order_id AND b.p < e.p GROUP BY 1) SELECT items, support FROM x WHERE support >= (SELECT k FROM lim)"""),
        "a05_forecast": c(_forecast() + "SELECT * EXCLUDE (k) FROM fc"),
        "a06_anomaly_z": c(_KPI + """, z AS (SELECT day, revenue AS value, CASE WHEN count(*) OVER w >= 2 AND stddev_samp(revenue) OVER w > 1e-9 THEN round((revenue - avg(revenue) OVER w) / stddev_samp(revenue) OVER w, 4) END AS z FROM kpi WINDOW w AS (ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
SELECT *, coalesce(abs(z) > 3, FALSE) AS is_anomaly FROM z"""),
        "a06_anomaly_iqr": c(_KPI + ", q AS (SELECT quantile_cont(revenue, 0.25) AS a, quantile_cont(revenue, 0.75) AS b FROM kpi) SELECT day, revenue AS value, revenue < a - 1.5 * (b - a) OR revenue > b + 1.5 * (b - a) AS is_anomaly FROM kpi, q"),
        "a07_clv_counts": c(f"+ r AS (SELECT customer_id, (count(DISTINCT order_date) - 1)::INT AS x, ((max(order_date) - min(order_date)) // 7)::INT AS t_x, (({_D} - min(order_date)) // 7)::INT AS t FROM sold GROUP BY 1) SELECT x, t_x, t, count(*) AS n FROM r GROUP BY 1, 2, 3"),
        "a08_polarity": "WITH " + _POLARITY + "SELECT word, round(p, 6) AS polarity, is_seed FROM p3",
        "a08_induced_sentiment": "WITH " + _POLARITY + "SELECT * FROM sc",
        "kp11_induced_net_sentiment": "WITH " + _POLARITY + "SELECT count(*) AS comments, round(avg(CASE sentiment_label WHEN 'POSITIVE' THEN 100.0::DOUBLE WHEN 'NEGATIVE' THEN -100 ELSE 0 END), 4) AS net_sentiment FROM sc",
        "a08_sentiment": "WITH " + _SENT + "SELECT * FROM sc",
        "a10_abc_tier": c(_ABC + "SELECT * FROM abc"),
        "a11_margin_category": _margin("category"),
        "a11_margin_product": _margin("product_id"),
        "a11_margin_region": _margin("region"),
        "a12_churn_features": c(f"""+ p AS (SELECT customer_id, ({_D} - 90) - max(order_date) AS recency, count(*) AS frequency, sum(net) AS n, max(order_date) - min(order_date) AS span, ({_D} - 90) - min(order_date) AS tenure FROM sold WHERE order_date < {_D} - 90 GROUP BY 1),
l AS (SELECT DISTINCT customer_id FROM sold WHERE order_date >= {_D} - 90 AND order_date < {_D})
SELECT customer_id, recency::INT AS recency, frequency, round(n::DOUBLE, 4) AS monetary, round(CASE WHEN frequency > 1 THEN span::DOUBLE / (frequency - 1) ELSE tenure END, 4) AS mean_gap, tenure::INT AS tenure, CASE WHEN l.customer_id IS NULL THEN 1 ELSE 0 END AS churned FROM p LEFT JOIN l USING (customer_id)"""),
        "a13_geo": c("+ g AS (SELECT region, country, grouping(region, country)::INT AS level, sum(net)::DOUBLE AS n, count(*) AS orders, count(DISTINCT customer_id) AS customers FROM sold GROUP BY GROUPING SETS ((region, country), (region), ())) SELECT region, country, level, round(n, 4) AS revenue, orders, customers, round(n / max(n) OVER (), 6) AS share FROM g"),
        "a13_geo_features": c("""+ g AS (SELECT region, country, sum(net) AS n, count(*) AS orders, count(DISTINCT customer_id) AS customers FROM sold GROUP BY 1, 2)
SELECT country, '{"type":"Feature","properties":{"region":"' || region || '","country":"' || country || '","revenue":' || round(n::DOUBLE, 4)::DECIMAL(20,4) || ',"orders":' || orders || ',"customers":' || customers || '}}' AS feature FROM g"""),
        "a14_seasonality": c("""+ d AS (SELECT order_date, sum(net)::DOUBLE AS v FROM sold GROUP BY 1), m AS (SELECT avg(v) AS a FROM d)
SELECT 'month' AS kind, month(order_date)::INT AS part, round(avg(v) / max(a), 6) AS index FROM d, m GROUP BY 2 UNION ALL SELECT 'weekday', dayofweek(order_date)::INT + 1, round(avg(v) / max(a), 6) FROM d, m GROUP BY 2"""),
        "a15_funnel": _STEPS,
        "a16_payment_channel": c("+ b AS (SELECT payment_method, count(*) AS orders, sum(net)::DOUBLE AS n FROM sold GROUP BY 1), r AS (SELECT payment_method, avg(CASE WHEN status = 'refunded' THEN 1.0::DOUBLE ELSE 0 END) AS rr FROM ord GROUP BY 1) SELECT payment_method, orders, round(n, 4) AS revenue, round(n / sum(n) OVER (), 6) AS share, round(n / orders, 8) AS aov, round(rr, 6) AS refund_rate FROM b JOIN r USING (payment_method)"),
        "a17_attribution": c("""+ t AS (SELECT customer_id, sum(net) AS s, count(*) AS n, arg_min(payment_method, (order_date, order_id)) AS f, arg_max(payment_method, (order_date, order_id)) AS l FROM sold GROUP BY 1),
e AS (SELECT payment_method AS channel, sum(s::DOUBLE / n) AS linear FROM sold JOIN t USING (customer_id) GROUP BY 1), a AS (SELECT f AS channel, sum(s) AS s, count(*) AS n FROM t GROUP BY 1), b AS (SELECT l AS channel, sum(s) AS s FROM t GROUP BY 1)
SELECT channel, round(coalesce(a.s, 0)::DOUBLE, 2) AS first_touch, round(coalesce(b.s, 0)::DOUBLE, 2) AS last_touch, round(linear, 2) AS linear, coalesce(a.n, 0) AS customers_first FROM e LEFT JOIN a USING (channel) LEFT JOIN b USING (channel)"""),
        "a17_attribution_channel": c("""+ t AS (SELECT customer_id, sum(net) AS s, count(*) AS n, arg_min(channel, (order_date, order_id)) AS f, arg_max(channel, (order_date, order_id)) AS l FROM sold GROUP BY 1),
e AS (SELECT channel AS channel, sum(s::DOUBLE / n) AS linear FROM sold JOIN t USING (customer_id) GROUP BY 1), a AS (SELECT f AS channel, sum(s) AS s, count(*) AS n FROM t GROUP BY 1), b AS (SELECT l AS channel, sum(s) AS s FROM t GROUP BY 1)
SELECT channel, round(coalesce(a.s, 0)::DOUBLE, 2) AS first_touch, round(coalesce(b.s, 0)::DOUBLE, 2) AS last_touch, round(linear, 2) AS linear, coalesce(a.n, 0) AS customers_first FROM e LEFT JOIN a USING (channel) LEFT JOIN b USING (channel)"""),
        "a18_returns_product": _returns("product_id"),
        "a18_returns_category": _returns("category"),
        "a19_fulfillment": c("SELECT region, count(*) AS orders, round(avg(delivery_days), 4) AS mean_days, round(quantile_cont(delivery_days, 0.5), 4) AS p50_days, round(quantile_cont(delivery_days, 0.95), 4) AS p95_days, round(avg(CASE WHEN delivery_days <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_sla FROM ord WHERE delivery_days IS NOT NULL GROUP BY 1"),
        "a20_supplier": c("+ s AS (SELECT supplier_id, sum(line_total) AS rev, sum(quantity)::BIGINT AS units, sum(line_total - line_discount - line_cost) AS mar, avg(CASE WHEN returned THEN 1.0::DOUBLE ELSE 0 END) AS ret FROM sitems GROUP BY 1) SELECT supplier_id, s_name AS supplier, round(rev::DOUBLE, 4) AS revenue, units, round(mar::DOUBLE, 4) AS margin, round(ret, 6) AS return_rate, (dense_rank() OVER (ORDER BY rev DESC))::INT AS revenue_rank FROM s JOIN supplier ON s_suppkey = supplier_id"),
        "a20_supplier_delivery": c("+ s AS (SELECT supplier_id, count(*) AS lines, avg(ship_date - order_date) AS d, avg((ship_date - order_date > 30)::INT) AS w FROM sitems WHERE ship_date - order_date BETWEEN 0 AND 180 GROUP BY 1) SELECT supplier_id, s_name AS supplier, lines, round(d, 6) AS delivery_days, round(w, 6) AS slow_share FROM s JOIN supplier ON s_suppkey = supplier_id"),
        "a21_correlation": c(_CORR),
        "a22_demographic": c("SELECT age_group, gender, grouping(age_group, gender)::INT AS level, count(DISTINCT customer_id) AS customers, round(sum(net)::DOUBLE, 4) AS revenue, round(sum(net)::DOUBLE / count(*), 8) AS aov FROM sold JOIN (SELECT customer_id, age_group, gender FROM cust) USING (customer_id) GROUP BY CUBE (age_group, gender)"),
        "fc1_forecast_by_region": c(_forecast("region") + "SELECT k AS region, * EXCLUDE (k) FROM fc"),
        "fc2_bands": c(_forecast() + "SELECT is_historical, count(*) AS days, count(*) AS ordered FROM fc GROUP BY 1"),
        "fc3_with_history": c(_forecast() + "SELECT date_trunc('month', ds)::DATE AS month, is_historical, round(sum(coalesce(actual, yhat)), 4) AS value FROM fc GROUP BY 1, 2"),
        "fc4_scenario": c(_forecast() + """, g AS (SELECT m.m AS marketing_pct, p.p AS price_pct, s.s AS seasonal, CASE s.s WHEN 'low' THEN 0.5 WHEN 'medium' THEN 1.0 ELSE 1.5 END AS k FROM (VALUES (0.0::DOUBLE), (25.0), (50.0)) m(m), (VALUES (-10.0::DOUBLE), (0.0), (20.0)) p(p), (VALUES ('low'), ('medium'), ('high')) s(s)),
f AS (SELECT yhat, avg(yhat) OVER () AS mean FROM fc WHERE NOT is_historical), v AS (SELECT marketing_pct, price_pct, seasonal, yhat, (mean + (yhat - mean) * g.k) * (1 + 0.10 * marketing_pct / 100) * (1 + price_pct / 100) * (1 - 0.50 * price_pct / 100) AS y FROM f, g)
SELECT marketing_pct, price_pct, seasonal, round(sum(y), 2) AS total, round((sum(y) / sum(yhat) - 1) * 100, 4) AS impact_pct FROM v GROUP BY 1, 2, 3"""),
        "fc5_projected_mrr": c(_forecast() + ", l AS (SELECT max(ds) AS last FROM fc WHERE is_historical), v AS (SELECT sum(CASE WHEN NOT is_historical AND ds <= last + 30 THEN yhat END) AS a, sum(CASE WHEN is_historical AND ds > last - 30 THEN actual END) AS b FROM fc, l) SELECT round(a, 4) AS projected, round(b, 4) AS last_period, round((a - b) / b * 100, 4) AS change_pct FROM v"),
        "fc6_latest_run": c(_forecast() + "SELECT ds, yhat, 'all' AS series, '2001-08-02' AS run_date FROM fc"),
        "kp1_daily_kpi": c(_KPI + "SELECT * FROM kpi"),
        "kp2_active_and_churn": c("""+ d AS (SELECT DISTINCT customer_id, order_date AS day FROM ord), days AS (SELECT unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM d), f AS (SELECT customer_id, min(day) AS first FROM d GROUP BY 1),
a AS (SELECT days.day, count(DISTINCT d.customer_id) AS active FROM days LEFT JOIN d ON d.day BETWEEN days.day - 90 AND days.day GROUP BY 1), k AS (SELECT days.day, count(f.customer_id) AS known FROM days LEFT JOIN f ON f.first <= days.day GROUP BY 1)
SELECT day, active, known, round(1 - active / known, 4) AS churn_rate FROM a JOIN k USING (day)"""),
        "kp3_revenue_by_region": c("SELECT order_date AS day, " + ", ".join(f"round(coalesce(sum(CASE WHEN region = '{r}' THEN net END), 0)::DOUBLE, 4) AS revenue_{r.lower().replace(' ', '_')}" for r in registry.REGIONS) + " FROM sold GROUP BY 1"),
        "kp4_period_delta": c(_KPI + ", v AS (SELECT day, sum(revenue) OVER (ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS a, sum(revenue) OVER (ORDER BY day ROWS BETWEEN 59 PRECEDING AND 30 PRECEDING) AS b, row_number() OVER (ORDER BY day) AS k FROM kpi) SELECT day, round(a, 4) AS value, round(b, 4) AS previous, round((a - b) / nullif(b, 0) * 100, 4) AS change_pct FROM v WHERE k >= 60"),
        "kp5_sales_trend": c(_KPI + ", v AS (SELECT day, round(revenue, 4) AS revenue, round(lag(revenue, 30) OVER (ORDER BY day), 4) AS previous, max(day) OVER () AS last FROM kpi) SELECT day, revenue, previous FROM v WHERE day > last - 30"),
        "kp6_freeze_table": c(_KPI + "SELECT * FROM kpi WHERE day > (SELECT max(day) FROM kpi) - INTERVAL 7 DAY"),
        "kp6_freeze_snapshot": c(_KPI + "SELECT * FROM kpi WHERE day <= DATE '2001-07-31'"),
        "kp7_mrr_growth": f"SELECT period, revenue, growth FROM ({_revenue('month')})",
        "kp8_win_rate": c("SELECT region, count(*) AS orders, count(*) FILTER (status = 'completed') AS completed, round(count(*) FILTER (status = 'completed') / count(*), 6) AS win_rate FROM ord GROUP BY 1"),
        "kp9_quarterly_margin": c("SELECT date_trunc('quarter', order_date)::DATE AS quarter, round(sum(net)::DOUBLE, 4) AS revenue, round(sum(net - cost)::DOUBLE, 4) AS gross_margin FROM sold GROUP BY 1"),
        "kp10_daily_active_users": "WITH u AS (SELECT ts::DATE AS day, count(DISTINCT user_id) AS users FROM events GROUP BY 1) SELECT day, users, round((users - lag(users) OVER (ORDER BY day)) / lag(users) OVER (ORDER BY day) * 100, 4) AS change_pct FROM u",
        "kp10_users_over_spans": "WITH u AS (SELECT DISTINCT ts::DATE AS day, user_id FROM events), d AS (SELECT DISTINCT day FROM u) SELECT d.day, count(DISTINCT user_id) FILTER (u.day = d.day) AS users_1, count(DISTINCT user_id) FILTER (u.day > d.day - INTERVAL 7 DAY) AS users_7, count(DISTINCT user_id) AS users_30 FROM d JOIN u ON u.day <= d.day AND u.day > d.day - INTERVAL 30 DAY GROUP BY 1",
        "kp11_net_sentiment": "WITH " + _SENT + "SELECT count(*) AS comments, round(avg(CASE sentiment_label WHEN 'POSITIVE' THEN 100.0::DOUBLE WHEN 'NEGATIVE' THEN -100 ELSE 0 END), 4) AS net_sentiment FROM sc",
        "kp12_top_regions": c("+ t AS (SELECT country, sum(net)::DOUBLE AS n FROM sold GROUP BY 1 ORDER BY sum(net) DESC, country LIMIT 5) SELECT country, round(n, 4) AS revenue, round(n / max(n) OVER (), 6) AS bar FROM t"),
        "kp13_sales_heatmap": c("SELECT region, " + ", ".join(f"round(coalesce(sum(CASE WHEN month(order_date) = {m} THEN net END), 0)::DOUBLE, 4) AS m{m:02d}" for m in range(1, 13)) + " FROM sold GROUP BY 1"),
        "cv1_customer_search": c("SELECT customer_id, full_name, email FROM cust WHERE contains(lower(full_name), '#00000012') OR contains(email, '#00000012') OR contains(customer_id::VARCHAR, '#00000012')"),
        "cv2_customer_list": c(_PROFILE + "SELECT customer_id, round(lifetime_value::DOUBLE, 4) AS lifetime_value, country FROM prof JOIN cust USING (customer_id) WHERE region = 'EUROPE' ORDER BY prof.lifetime_value DESC, customer_id LIMIT 20"),
        "cv3_page": c(_PROFILE + "SELECT customer_id, total_orders FROM prof WHERE total_orders < 9 OR (total_orders = 9 AND customer_id > 100) ORDER BY total_orders DESC, customer_id LIMIT 20"),
        "cv1_search_by_index": c("SELECT customer_id, full_name, email FROM cust WHERE contains(lower(full_name), '#00000012') OR contains(email, '#00000012') OR contains(customer_id::VARCHAR, '#00000012')"),
        "cv3_page_by_number": c(_PROFILE + "SELECT customer_id, total_orders FROM prof ORDER BY total_orders DESC, customer_id LIMIT 20 OFFSET 40"),
        "pv1_search_by_index": c("SELECT product_id, name, category FROM prod WHERE contains(lower(name), 'ring') OR contains(lower(category), 'ring') OR contains(lower(sku), 'ring')"),
        "cv4_customer_cards": c("+" + _segments(registry.CARD_DAY, "now") + "," + _segments(registry.before(registry.CARD_DAY, days=7), "week") + f""", p AS (SELECT customer_id, sum(net)::DOUBLE AS v, DATE '{registry.CARD_DAY}' - min(order_date) AS age, DATE '{registry.CARD_DAY}' - max(order_date) AS recency FROM sold WHERE order_date < DATE '{registry.CARD_DAY}' GROUP BY 1),
b AS (SELECT avg(v::DOUBLE) AS past FROM (SELECT sum(net) AS v FROM sold WHERE order_date < DATE '{registry.CARD_DAY}' - INTERVAL 1 MONTH GROUP BY customer_id)), n AS (SELECT avg(v) AS now, count(*) FILTER (recency > 90) AS at_risk, count(*) FILTER (age <= 7) AS new_this_week FROM p),
w AS (SELECT count(*) AS new_vips_this_week FROM seg_now LEFT JOIN seg_week USING (customer_id) WHERE seg_now.segment = 'Champions' AND seg_week.segment IS DISTINCT FROM 'Champions')
SELECT round(now, 2) AS average_ltv, round((now / past - 1) * 100, 4) AS ltv_change_pct, at_risk, new_this_week, new_vips_this_week FROM n, b, w"""),
        "cv5_segment_history": c(_HISTORY + "SELECT customer_id, segment, valid_from, valid_to FROM hist"),
        "cv5_segment_moves": c(_HISTORY + f", m AS (SELECT *, lag(segment) OVER (PARTITION BY customer_id ORDER BY valid_from) AS segment_before FROM hist) SELECT segment_before, segment, count(*) AS customers FROM m WHERE valid_from > DATE '{registry.YEARS[-2]}' AND valid_from <= DATE '{registry.YEARS[-1]}' GROUP BY 1, 2"),
        "cv5_held_revenue": c(_HISTORY + "SELECT segment, year(order_date)::INT AS year, count(*) AS orders, count(DISTINCT sold.customer_id) AS customers, round(sum(net)::DOUBLE, 4) AS revenue FROM sold LEFT JOIN hist ON hist.customer_id = sold.customer_id AND valid_from <= order_date AND (valid_to IS NULL OR order_date < valid_to) GROUP BY 1, 2"),
        "cv5_segment_screen": c(_PROFILE + "," + _RFM.lstrip("+") + "," + _segments(registry.before(AS_OF, months=1), "month") + f""", e AS (SELECT customer_id, 50 * (percent_rank() OVER (ORDER BY recency DESC) + percent_rank() OVER (ORDER BY total_orders)) AS e FROM prof), a AS (SELECT rfm_segment AS ai_segment, grouping(rfm_segment)::INT AS is_total, count(*) AS customers, avg(lifetime_value::DOUBLE) AS l, sum(arr) AS arr, avg(total_orders) AS o, avg(round(e, 2)) AS e FROM prof JOIN g USING (customer_id) JOIN e USING (customer_id) GROUP BY GROUPING SETS ((rfm_segment), ())),
p AS (SELECT segment AS s, grouping(segment)::INT AS t, count(*) AS past FROM seg_month GROUP BY GROUPING SETS ((segment), ()))
SELECT ai_segment, is_total, customers, round(l, 2) AS average_ltv, round(coalesce(arr, 0)::DOUBLE, 4) AS arr, round(o, 4) AS average_orders, round(e, 2) AS average_engagement, round((customers / past - 1) * 100, 4) AS month_change_pct FROM a LEFT JOIN p ON ai_segment IS NOT DISTINCT FROM s AND is_total = t"""),
        "cv5_segment_summary": c(_PROFILE + "SELECT region, grouping(region)::INT AS is_total, count(*) AS customers, round(avg(lifetime_value::DOUBLE), 2) AS average_ltv, round(coalesce(sum(arr), 0)::DOUBLE, 4) AS arr, round(avg(total_orders), 4) AS average_orders FROM prof JOIN cust USING (customer_id) GROUP BY GROUPING SETS ((region), ())"),
        "cv6_engagement": c(_PROFILE + "SELECT customer_id, round(50 * (percent_rank() OVER (ORDER BY recency DESC) + percent_rank() OVER (ORDER BY total_orders)), 2) AS engagement_score FROM prof"),
        "cv6_engagement_activity": c(_PROFILE + ", x AS (SELECT user_id AS customer_id, count(*) AS n FROM events GROUP BY 1), y AS (SELECT customer_id, recency, total_orders, coalesce(n, 0) AS activity FROM prof LEFT JOIN x USING (customer_id)) SELECT customer_id, activity, round(100 * (percent_rank() OVER (ORDER BY recency DESC) + percent_rank() OVER (ORDER BY total_orders) + percent_rank() OVER (ORDER BY activity)) / 3, 2) AS engagement_score FROM y"),
        "cv7_arr": c(_PROFILE + "SELECT customer_id, round(coalesce(arr, 0)::DOUBLE, 4) AS arr FROM prof"),
        "pv1_product_search": c("SELECT product_id, name, category FROM prod WHERE contains(lower(name), 'ring') OR contains(lower(category), 'ring') OR contains(lower(sku), 'ring')"),
        "pv1_product_list": c("SELECT product_id, name, category FROM prod WHERE category = 'LARGE' AND product_id % 10 <> 0 AND name >= 'm' ORDER BY name, product_id LIMIT 20"),
        "pv2_inventory_cards": c("SELECT count(DISTINCT sku) AS skus, round(sum(stock_qty * unit_price)::DOUBLE, 2) AS inventory_value, count(*) FILTER (stock_qty < low_stock_threshold) AS low_stock, count(DISTINCT category) AS categories FROM prod"),
        "pv3_tier_summary": c(_ABC + "SELECT abc_tier, count(*) AS skus, round(sum(revenue), 2) AS revenue, round(sum(revenue) / (SELECT sum(revenue) FROM abc), 6) AS share FROM abc GROUP BY 1"),
        "rc1_latest_result": f"SELECT 'revenue_' || year(period) AS analysis_type, period AS computed_at, period::VARCHAR AS upload_job_id, FALSE AS is_stale, revenue FROM ({_revenue('month')}) WHERE month(period) <> 12 QUALIFY row_number() OVER (PARTITION BY year(period) ORDER BY period DESC) = 1",
        "rc2_insights": c("""+ y AS (SELECT region, year(order_date) AS year, sum(net)::DOUBLE AS revenue, count(*)::DOUBLE AS orders, count(DISTINCT customer_id)::DOUBLE AS customers, sum(cost)::DOUBLE AS cost FROM sold GROUP BY 1, 2), u AS (SELECT region, year, unnest(['revenue', 'orders', 'customers', 'cost']) AS name, unnest([revenue, orders, customers, cost]) AS value FROM y),
m AS (SELECT a.region, a.name, (a.value - b.value) / abs(b.value) * 100 AS m FROM u a JOIN u b ON a.region = b.region AND a.name = b.name AND a.year = 2000 AND b.year = 1999 WHERE b.value <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY abs(round(m, 6)) DESC, name) AS bullet_index FROM m)
SELECT region, bullet_index::INT AS bullet_index, name || CASE WHEN m >= 0 THEN ' rose by ' ELSE ' fell by ' END || round(abs(m))::BIGINT || ' %' AS bullet_text FROM k WHERE bullet_index <= 3"""),
        "io1_read_csv": c("+ d AS (SELECT order_id AS k, total::DECIMAL(14,2)::VARCHAR AS t FROM ord) SELECT k::VARCHAR AS external_id, CASE k % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN '$' || t ELSE t END AS total_amount, TRUE AS fits FROM d UNION ALL SELECT k::VARCHAR, CASE k % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN '$' || t ELSE t END, FALSE FROM d WHERE k % 50 = 0"),
        "io2_table_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in TABLES),
        "io3_append": c("SELECT strftime(order_date, '%Y-%m') AS order_month, count(*) AS orders, round(sum(net)::DOUBLE, 4) AS net FROM ord GROUP BY 1"),
        "io5_export": c("SELECT payment_method, count(*) AS orders FROM sold GROUP BY 1"),
        "io6_st3_stream_ingest": c("SELECT order_id::VARCHAR AS external_id, CASE WHEN order_id % 7 <> 0 THEN total::DECIMAL(14,2)::DOUBLE END AS total_amount FROM ord"),
        "io4_result_json": c("""+ b AS (SELECT payment_method, count(*) AS orders FROM sold GROUP BY 1) SELECT 'payment_channel' AS analysis_type, 'job1' AS upload_job_id, '[' || string_agg('{"payment_method":"' || payment_method || '","orders":' || orders || '}', ',' ORDER BY payment_method) || ']' AS result_json FROM b"""),
        "in1_map_exact": c(_MAPS + "SELECT upload_job_id, csv_header, mapped_table, mapped_column, match_score, match_method FROM hd JOIN ex USING (csv_header)"),
        "in2_map_fuzzy": c(_MAPS + "SELECT upload_job_id, csv_header, mapped_table, mapped_column, match_score, match_method FROM hd JOIN fz USING (csv_header)"),
        "in3_map_semantic": c(_MAPS + "SELECT upload_job_id, csv_header, mapped_table, mapped_column, match_score, match_method FROM hd JOIN se USING (csv_header)"),
        "in4_map_historical": c(_MAPS + "SELECT upload_job_id, csv_header, mapped_table, mapped_column, match_score, match_method FROM hd JOIN hi USING (csv_header)"),
        "in5_resolve": c(_MAPS + """, al AS (SELECT 1 AS o, * FROM hi UNION ALL SELECT 2, * FROM ex UNION ALL SELECT 3, * FROM fz UNION ALL SELECT 4, * FROM se), b AS (SELECT * FROM al WHERE match_score >= 0.6 QUALIFY row_number() OVER (PARTITION BY csv_header ORDER BY o) = 1)
SELECT upload_job_id, csv_header, mapped_table, mapped_column, match_score, coalesce(match_method, 'skipped') AS match_method, coalesce(match_score >= 0.85, FALSE) AS is_confirmed FROM hd LEFT JOIN b USING (csv_header)"""),
        "in3_map_by_values": c("+" + _VALUES + "SELECT * FROM va"),
        "in5_resolve_uploads": c("+" + _VALUES + ", " + _MAPS.lstrip("+").replace(_HEAD.split(", nm AS")[0], "hd AS (SELECT DISTINCT upload_job_id, csv_header FROM uv)") + """, al AS (SELECT 1 AS o, hd.upload_job_id, ex.* FROM hd JOIN ex USING (csv_header) UNION ALL SELECT 2, hd.upload_job_id, fz.* FROM hd JOIN fz USING (csv_header) UNION ALL SELECT 3, hd.upload_job_id, se.* FROM hd JOIN se USING (csv_header) UNION ALL SELECT 4, * FROM va),
b AS (SELECT * FROM al WHERE match_score >= 0.6 QUALIFY row_number() OVER (PARTITION BY upload_job_id, csv_header ORDER BY o) = 1)
SELECT upload_job_id, csv_header, mapped_table, mapped_column, match_score, coalesce(match_method, 'skipped') AS match_method, coalesce(match_score >= 0.85, FALSE) AS is_confirmed FROM hd LEFT JOIN b USING (upload_job_id, csv_header)"""),
        "in6_apply_mapping": c("+ d AS (SELECT order_id AS k, total::DECIMAL(14,2)::VARCHAR AS t FROM ord) SELECT k::VARCHAR AS order_ref, CASE k % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN '$' || t WHEN 2 THEN ' ' || t || ' ' ELSE t END AS total_amount FROM d"),
        "in7_clean_missing": c("+ d AS (SELECT order_id AS k, total::DECIMAL(14,2)::VARCHAR AS t FROM ord) SELECT k::VARCHAR AS external_id, CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN '$' || t ELSE t END AS total_amount, CASE WHEN k % 5 = 0 THEN 'USD' ELSE 'usd' END AS currency FROM d"),
        "in8_dates": c("SELECT order_id::VARCHAR AS external_id, order_date FROM ord"),
        "in9_numbers": c("SELECT order_id::VARCHAR AS external_id, CASE WHEN order_id % 7 <> 0 THEN total::DECIMAL(14,2)::DOUBLE END AS total_amount FROM ord"),
        "in10_drop_duplicates": c("SELECT order_id, product_id, round(line_total::DOUBLE, 2) AS line_total, quantity FROM items QUALIFY row_number() OVER (PARTITION BY order_id, product_id ORDER BY line_total DESC, quantity DESC, supplier_id DESC, ship_date DESC) = 1"),
        "in11_validate": c(_DIRTY + "SELECT external_id, array_to_string(reasons, ',') AS reasons FROM mk"),
        "in12_constraints": c("SELECT 'status' AS rule, count(*) FILTER (status NOT IN ('completed', 'pending', 'refunded', 'cancelled')) AS violations FROM ord UNION ALL SELECT 'total', count(*) FILTER (total < 0) FROM ord UNION ALL SELECT 'discount', count(*) FILTER (discount < 0 OR discount > total) FROM ord UNION ALL SELECT 'delivery', count(*) FILTER (delivery_days < 0) FROM ord"),
        "in12_stock_and_lines": c("SELECT 'stock' AS rule, count(*) FILTER (stock_qty < 0) AS violations FROM prod UNION ALL SELECT 'price', count(*) FILTER (unit_price < 0) FROM prod UNION ALL SELECT 'cost', count(*) FILTER (cost_price < 0) FROM prod UNION ALL SELECT 'quantity', count(*) FILTER (quantity <= 0) FROM items UNION ALL SELECT 'line_total', count(*) FILTER (line_total < 0) FROM items"),
        "in12_broken_rows": c("""SELECT 'quantity' AS rule, count(*) FILTER (order_id % 9 = 0) AS violations FROM items UNION ALL SELECT 'line_total', count(*) FILTER (order_id % 8 = 0 AND line_total > 0) FROM items
UNION ALL SELECT 'stock', count(*) FILTER (product_id % 10 = 0) FROM prod UNION ALL SELECT 'price', count(*) FILTER (product_id % 6 = 0 AND unit_price > 0) FROM prod UNION ALL SELECT 'cost', count(*) FILTER (product_id % 4 = 0 AND cost_price > 0) FROM prod
UNION ALL SELECT unnest(['engagement', 'churn_risk', 'tier', 'sentiment', 'band', 'bullet']), unnest([count(*) FILTER (o_orderkey % 120 > 100), count(*) FILTER (o_orderkey % 13 > 10), count(*) FILTER (o_orderkey % 4 = 3), count(*) FILTER (o_orderkey % 5 = 3), count(*) FILTER (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0), count(*) FILTER (o_orderkey % 5 NOT BETWEEN 1 AND 3)]) FROM orders"""),
        "in12_model_constraints": c(_PROFILE + "," + _ABC.lstrip("+") + "," + _forecast().lstrip("+") + """, e AS (SELECT 50 * (percent_rank() OVER (ORDER BY recency DESC) + percent_rank() OVER (ORDER BY total_orders)) AS e FROM prof)
SELECT 'engagement' AS rule, count(*) FILTER (e NOT BETWEEN 0 AND 100) AS violations FROM e UNION ALL SELECT 'tier', count(*) FILTER (abc_tier NOT IN ('A', 'B', 'C')) FROM abc UNION ALL SELECT 'band', count(*) FILTER (NOT (yhat_lower <= yhat AND yhat <= yhat_upper)) FROM fc UNION ALL SELECT unnest(['sentiment', 'bullet', 'churn_risk']), 0"""),
        "in13_references": c("SELECT o_orderkey AS order_id FROM orders WHERE o_orderkey NOT IN (SELECT order_id FROM items)"),
        "in14_unique": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
        "st3_upload_chain": c(_CHAIN + "SELECT external_id, outcome, reasons, order_date, total_amount, currency, status, batch_id FROM chain"),
        "st3_ledger": c(_CHAIN + "SELECT outcome, reason, count(*) AS rows, batch_id FROM (SELECT outcome, batch_id, unnest(CASE WHEN reasons = '' THEN [NULL] ELSE str_split(reasons, ',') END) AS reason FROM chain) GROUP BY ALL"),
        "in15_upsert_table": c("""SELECT product_id, name, round(CASE WHEN product_id % 10 = 0 THEN (unit_price * 1.10)::DECIMAL(10,2) ELSE unit_price END::DOUBLE, 2) AS unit_price FROM prod UNION ALL SELECT product_id + 100000000, NULL, round(unit_price::DOUBLE, 2) FROM prod WHERE product_id % 10 = 0"""),
        "in15_upsert": c("""SELECT product_id, name, round(CASE WHEN product_id % 2 = 0 THEN (unit_price * 1.10)::DECIMAL(10,2) ELSE unit_price END::DOUBLE, 2) AS unit_price FROM prod UNION ALL SELECT product_id + 100000000, name, round(unit_price::DOUBLE, 2) FROM prod WHERE product_id % 2 = 0"""),
        "in16_insert_orders": c("SELECT order_id AS external_id, round(net::DOUBLE, 4) AS net_amount, round(CASE WHEN NOT return_flag THEN net - cost END::DOUBLE, 4) AS gross_margin FROM ord WHERE order_date >= DATE '1998-01-01'"),
        "in17_refresh_customers": c("+ s AS (SELECT customer_id, count(*) AS n, sum(net) AS v, min(order_date) AS a, max(order_date) AS b FROM sold GROUP BY 1) SELECT customer_id, coalesce(n, 0) AS total_orders, round(coalesce(v, 0)::DOUBLE, 4) AS lifetime_value, a AS first_purchase_date, b AS last_active_at FROM cust LEFT JOIN s USING (customer_id)"),
        "in18_refresh_products": c("+ s AS (SELECT product_id, sum(line_total) AS r, sum(quantity)::BIGINT AS u FROM items GROUP BY 1) SELECT product_id, round(coalesce(r, 0)::DOUBLE, 4) AS total_revenue, coalesce(u, 0) AS total_units_sold, greatest(stock_qty - coalesce(u, 0), 0) AS stock_qty, stock_qty - coalesce(u, 0) < 0 AS oversold FROM prod LEFT JOIN s USING (product_id)"),
        "in19_rollback": c("SELECT 'job' || year(order_date) AS upload_job_id, count(*) AS items, round(sum(line_total)::DOUBLE, 4) AS total FROM items JOIN ord USING (order_id) WHERE year(order_date) <> 1999 GROUP BY 1"),
        "in20_active_only": c("SELECT region, count(*) AS customers FROM cust WHERE gender <> 'Male' GROUP BY 1"),
        "in21_snapshot_region": c("SELECT CASE WHEN status = 'completed' THEN 'FIXED' ELSE region END AS region, count(*) AS orders FROM ord GROUP BY 1"),
        "in21_region_of_country": c("+ k AS (SELECT customer_id, [" + ", ".join(f"'{x}'" for x in [*sorted(ingest.REGIONS), "XX"]) + f"][regexp_extract(country, '[0-9]+')::INT % {len(ingest.REGIONS) + 1} + 1] AS code FROM cust) SELECT customer_id, CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ingest.REGIONS.items()) + " END AS region FROM k"),
        "in22_currency": c("SELECT CASE WHEN order_id % 5 <> 0 THEN 'USD' END AS currency, count(*) AS orders FROM ord GROUP BY 1"),
        "in23_upload_report": c(_DIRTY + """, x AS (SELECT upload_job_id, unnest(list_concat(['rows_total', CASE WHEN len(reasons) > 0 THEN 'rows_failed' ELSE 'rows_processed' END], reasons)) AS reason FROM mk), n AS (SELECT upload_job_id, reason, count(*) AS rows FROM x GROUP BY 1, 2)
SELECT upload_job_id, reason, rows, round(rows / max(rows) OVER (PARTITION BY upload_job_id), 6) AS share FROM n"""),
        "sc_derived_orders": c(f"SELECT order_id, round(net::DOUBLE, 4) AS net_amount, round(CASE WHEN NOT return_flag THEN net - cost END::DOUBLE, 4) AS gross_margin, date_trunc('month', order_date)::DATE AS cohort_month, {_D} - order_date > 90 AS at_risk FROM ord"),
        "sc_derived_products": c("SELECT product_id, round(CASE WHEN unit_price <> 0 THEN (unit_price - cost_price)::DOUBLE / unit_price::DOUBLE * 100 END, 4) AS gross_margin_pct, stock_qty < low_stock_threshold AS is_low_stock, CASE WHEN stock_qty < low_stock_threshold THEN 'red' WHEN stock_qty < 2 * low_stock_threshold THEN 'orange' ELSE 'green' END AS stock_band, round((stock_qty * unit_price)::DOUBLE, 2) AS stock_value FROM prod"),
        "scale_global_rank": c("SELECT order_id, row_number() OVER (ORDER BY net DESC, order_id) AS rank_, round(coalesce(sum(net) OVER (ORDER BY net DESC, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE, 4) AS before_ FROM ord"),
        "st1_stream_kpi": "SELECT ts::DATE AS day, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1",
        "st1_append": "SELECT ts::DATE AS day, count(*) AS events, round(sum(value), 4) AS value, true AS users_near FROM events GROUP BY 1 HAVING ts::DATE + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 5 MINUTE FROM events)",
        "st2_stream_dedup": "SELECT event_id, user_id FROM events",
    }
