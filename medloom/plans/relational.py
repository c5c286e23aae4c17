"""Queries of the core operators over the driver's tables, each with its DuckDB twin.

Analogies: a part is a drug, the words of its name are ingredients, an order is
a prescription, an event is a log entry, an embedding is a pill image.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.functions import dates, numeric, rules, similarity, text
from medloom.operators import dedupe, layout, matching, pairs, profiles, quality, resolve, schedule, sessions
from medloom.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Texts of which the severity rules make the six classes, in order of rank.
SEVERITY_TEXTS = ("Chống chỉ định", "Nghiêm trọng", "Trung bình", "Nhẹ", "Thận trọng", "Không xác định")
_CLASSES = ", ".join(f"'{s}'" for s in rules.SEVERITY)


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")


_PAIRS = """one AS (SELECT DISTINCT l_orderkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey),
pairs AS (SELECT x.l_orderkey, x.p_name AS a, y.p_name AS b FROM one x JOIN one y ON x.l_orderkey = y.l_orderkey AND x.p_name < y.p_name)"""


@query(
    "q01_pair_interactions",
    f"""WITH {_PAIRS}, rated AS (SELECT *, (length(a) + length(b)) % 6 AS rank FROM pairs)
SELECT l_orderkey, {", ".join(f"count(*) FILTER (rank = {k}) AS n_{s}" for k, s in enumerate(rules.SEVERITY))}, count(*) AS total,
  list_extract([{_CLASSES}], CAST(min(rank) + 1 AS BIGINT)) AS highest
FROM rated GROUP BY l_orderkey""",
)
def q01(spark, d):
    found = pairs.basket_pairs(_names(spark, d), "l_orderkey", "p_name")
    said = F.element_at(F.array(*map(F.lit, SEVERITY_TEXTS)), ((F.length("a") + F.length("b")) % 6 + 1).cast("int"))
    return pairs.severity_summary(found.withColumn("severity", rules.severity(said)), "l_orderkey")


_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, CAST(length(w) + 2 AS BIGINT)), lambda i: substring('  ' || w || ' ', CAST(i AS BIGINT), 3)))))"
_SIM = "(len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1}))))"
#: The query set: the names of the parts whose id is divisible by 50, without their third letter.
_ASKED = "(SELECT DISTINCT substring(p_name, 1, 2) || substring(p_name, 4) AS q FROM part WHERE p_partkey % 50 = 0) asked"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    damaged = F.concat(F.substring("p_name", 1, 2), F.substr("p_name", F.lit(4)))
    return table(spark, d, "part").where("p_partkey % 50 = 0").select(damaged.alias("q")).distinct()


@query(
    "q02_trigram_search",
    f"""WITH s AS (SELECT q, p_partkey, p_name, {_SIM.format(_TRI.format("q"), _TRI.format("p_name"))} AS sim FROM part, {_ASKED}),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, p_partkey) AS rank FROM s WHERE sim >= 0.3)
SELECT q, p_partkey, p_name, round(sim, 6) AS sim, rank FROM r WHERE rank <= 10""",
)
def q02(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    near = resolve.trigram_join(_asked(spark, d), "q", part, "p_name", 0.3).join(part, "p_name")
    best = dedupe.top_per_group(near, ["q"], [F.desc("sim"), F.col("p_partkey")], 10, "rank")
    return best.select("q", "p_partkey", "p_name", F.round("sim", 6).alias("sim"), "rank")


@query(
    "q03_tiered_resolve",
    f"""WITH n AS (SELECT DISTINCT p_name FROM part), s AS (SELECT q, p_name, {_SIM.format(_TRI.format("q"), _TRI.format("p_name"))} AS sim FROM n, {_ASKED}),
t AS (SELECT *, CASE WHEN lower(q) = lower(p_name) THEN 0 WHEN starts_with(lower(p_name), lower(q)) THEN 1 ELSE 2 END AS tier FROM s WHERE sim >= 0.2),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tier, sim DESC, p_name) AS n FROM t)
SELECT q, p_name, tier, round(sim, 6) AS sim FROM r WHERE n = 1""",
)
def q03(spark, d):
    return resolve.tiered_resolve(_asked(spark, d), "q", table(spark, d, "part"), "p_name").select("q", "p_name", "tier", F.round("sim", 6).alias("sim"))


@query(
    "q04_tier_search",
    """SELECT p_partkey, p_name, CASE WHEN starts_with(lower(p_name), 'r') THEN 0 ELSE 1 END AS tier FROM part
WHERE contains(lower(p_name), 'r') ORDER BY 3, p_name, p_partkey LIMIT 50""",
)
def q04(spark, d):
    part = table(spark, d, "part")
    tier = F.when(F.lower("p_name").startswith("r"), 0).otherwise(1)
    return part.where(F.lower("p_name").contains("r")).select("p_partkey", "p_name", tier.alias("tier")).orderBy("tier", "p_name", "p_partkey").limit(50)


@query(
    "q05_token_sort",
    f"""WITH RECURSIVE n AS (SELECT DISTINCT p_name, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS b FROM part),
a AS (SELECT q, array_to_string(list_sort(string_split(q, ' ')), ' ') AS a FROM {_ASKED}),
lcs AS (
  SELECT q, p_name, a, b, 0 AS i, list_transform(range(0, CAST(length(b) + 1 AS BIGINT)), lambda x: 0) AS r FROM a, n
  UNION ALL
  SELECT q, p_name, a, b, i + 1, list_reduce(range(1, CAST(length(b) + 1 AS BIGINT)), lambda acc, j:
    list_append(acc, CASE WHEN substring(a, i + 1, 1) = substring(b, CAST(j AS BIGINT), 1) THEN r[j] + 1 ELSE greatest(r[j + 1], acc[j]) END), [0])
  FROM lcs WHERE i < length(a)
), s AS (SELECT q, p_name, round(200.0 * r[length(b) + 1] / (length(a) + length(b)), 6) AS score FROM lcs WHERE i = length(a)),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, p_name) AS rank FROM s)
SELECT q, p_name, score, rank FROM k WHERE rank <= 5""",
)
def q05(spark, d):
    # A stated query set against all distinct names.
    names = table(spark, d, "part").select("p_name").distinct()
    asked = names.crossJoin(_asked(spark, d))
    scored = asked.withColumn("score", F.round(similarity.token_sort_ratio(F.col("q"), F.col("p_name")), 6))
    return dedupe.top_per_group(scored, ["q"], [F.desc("score"), F.col("p_name")], 5, "rank").select("q", "p_name", "score", "rank")


_STRENGTHS = "list_distinct(list_transform(regexp_extract_all(lower({}), '\\d+(?:[.,]\\d+)?\\s*(?:mg|ml|mcg|g|iu)'), lambda x: regexp_replace(replace(x, ',', '.'), '\\s*([a-z]+)$', ' \\1')))"


@query(
    "q06_strength_guard",
    f"""WITH s AS (SELECT row_id, brand_name, dosage, {_STRENGTHS.format("brand_name")} AS a, {_STRENGTHS.format("dosage")} AS b FROM drug_db_vn WHERE brand_name IS NOT NULL AND dosage IS NOT NULL)
SELECT row_id, len(a) AS n_name, len(b) AS n_dosage, (len(a) = 0 OR len(b) = 0 OR list_has_any(a, b)) AS fits FROM s""",
)
def q06(spark, d):
    rows = table(spark, d, "drug_db_vn").where("brand_name IS NOT NULL AND dosage IS NOT NULL")
    a, b = text.strength_tokens(F.col("brand_name")), text.strength_tokens(F.col("dosage"))
    return rows.select("row_id", F.size(a).cast("bigint").alias("n_name"), F.size(b).cast("bigint").alias("n_dosage"), text.strength_fits(F.col("brand_name"), F.col("dosage")).alias("fits"))


ALIASES = ((1, "red"), (2, "widget"), (3, "small"), (4, "old rod"), (5, "hot"))


@query(
    "q07_substring_first_match",
    f"""WITH al(n, alias) AS (VALUES {", ".join(f"({n}, '{a}')" for n, a in ALIASES)}),
m AS (SELECT p_partkey, p_name, alias, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN p_name = alias THEN 0 ELSE 1 END, n) AS k FROM part JOIN al ON contains(p_name, alias) OR contains(alias, p_name))
SELECT p_partkey, p_name, alias FROM m WHERE k = 1""",
)
def q07(spark, d):
    aliases = F.broadcast(spark.createDataFrame(ALIASES, "n int, alias string"))
    equal, part = F.col("p_name") == F.col("alias"), resolve.contains_either(F.col("p_name"), F.col("alias"))
    hits = resolve.first_hit(table(spark, d, "part").select("p_partkey", "p_name"), ["p_partkey"], [(equal, aliases), (part, aliases)], [F.col("n")])
    return hits.select("p_partkey", "p_name", "alias")


@query(
    "q08_page_with_total",
    """SELECT p_partkey, p_name, p_retailprice, (SELECT count(*) FROM part WHERE p_size >= 10) AS total FROM part WHERE p_size >= 10
ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40""",
)
def q08(spark, d):
    held = table(spark, d, "part").where("p_size >= 10")
    shown = quality.page(held.select("p_partkey", "p_name", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")], 3, 20)
    return shown.crossJoin(F.broadcast(held.agg(F.count("*").alias("total"))))  # one row


@query(
    "q09_first_wins",
    """WITH w AS (SELECT p_partkey, p_type, unnest(string_split(p_name, ' ')) AS word FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_type, word ORDER BY p_partkey) AS n FROM w)
SELECT p_type, word, p_partkey FROM r WHERE n = 1""",
)
def q09(spark, d):
    words = table(spark, d, "part").select("p_partkey", "p_type", F.explode(F.split("p_name", " ")).alias("word"))
    return dedupe.first_wins(words, ["p_type", "word"], ["p_partkey"]).select("p_type", "word", "p_partkey")


@query(
    "q10_last_wins",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM r WHERE n = 1""",
)
def q10(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return dedupe.last_wins(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate"]).drop("l_shipdate")


@query(
    "q11_pair_keys",
    f"""WITH {_PAIRS} SELECT DISTINCT a || ' || ' || b AS pair_key, sha1(a || ' || ' || b) AS dedupe_key FROM pairs""",
)
def q11(spark, d):
    found = pairs.basket_pairs(_names(spark, d), "l_orderkey", "p_name").select("a", "b").distinct()
    key = text.pair_key(F.col("b"), F.col("a"))
    return found.select(key.alias("pair_key"), F.sha1(key).alias("dedupe_key")).distinct()


@query(
    "q12_endpoint_catalogue",
    f"""WITH {_PAIRS}, e AS (SELECT unnest([a, b]) AS label FROM pairs) SELECT label AS key, count(*) AS n, label FROM e GROUP BY label""",
)
def q12(spark, d):
    return pairs.endpoint_catalogue(pairs.basket_pairs(_names(spark, d), "l_orderkey", "p_name"), "a", "b")


@query(
    "q13_endpoint_lookup",
    f"""WITH {_PAIRS}, p AS (SELECT a, b, count(*) AS n FROM pairs GROUP BY a, b), k AS (SELECT p_name FROM part WHERE p_size >= 45)
SELECT a, b, n, (a = 'red widget' OR b = 'red widget') AS either, (a IN (SELECT p_name FROM k) AND b IN (SELECT p_name FROM k)) AS both_ends FROM p
WHERE a = 'red widget' OR b = 'red widget' OR (a IN (SELECT p_name FROM k) AND b IN (SELECT p_name FROM k))""",
)
def q13(spark, d):
    found = pairs.basket_pairs(_names(spark, d), "l_orderkey", "p_name").groupBy("a", "b").agg(F.count("*").alias("n"))
    keys = table(spark, d, "part").where("p_size >= 45").select("p_name")
    one = pairs.either_end(found, "a", "b", F.lit("red widget")).withColumn("either", F.lit(True))
    two = pairs.both_ends(found, "a", "b", keys, "p_name").withColumn("both_ends", F.lit(True))
    joined = one.join(two, ["a", "b", "n"], "full_outer")
    return joined.fillna(False, ["either", "both_ends"]).select("a", "b", "n", "either", "both_ends")


@query(
    "q14_schedule",
    """WITH p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d0 FROM orders), x AS (SELECT o_orderkey, d0, CAST(unnest(range(0, 7)) AS INTEGER) AS k FROM p)
SELECT o_orderkey || ':' || strftime(d0 + k, '%Y-%m-%d') || ':' || slot AS occurrence, slot FROM x, (VALUES ('08:00'), ('20:00')) s(slot)""",
)
def q14(spark, d):
    plans = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("first"))
    doses = schedule.expand(plans, F.array(F.lit("08:00"), F.lit("20:00")), F.col("first"), F.date_add("first", 6))
    return doses.select(F.concat_ws(":", "o_orderkey", F.date_format("day", "yyyy-MM-dd"), "slot").alias("occurrence"), "slot")


_LOG = """log AS (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') || ':' || CASE WHEN hour(ts) < 12 THEN '08:00' WHEN hour(ts) < 17 THEN '14:00' ELSE '20:00' END AS id, event_id,
  CASE event_type WHEN 'purchase' THEN 'taken' WHEN 'error' THEN 'missed' WHEN 'click' THEN 'skipped' ELSE 'pending' END AS status, ts FROM events)"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    slot = F.when(F.hour("ts") < 12, "08:00").when(F.hour("ts") < 17, "14:00").otherwise("20:00")
    status = F.when(F.col("event_type") == "purchase", "taken").when(F.col("event_type") == "error", "missed").when(F.col("event_type") == "click", "skipped").otherwise("pending")
    return table(spark, d, "events").select(F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd"), slot).alias("id"), "event_id", status.alias("status"), "ts")


def _user_doses(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select("user_id").distinct()
    doses = schedule.expand(users, F.array(*map(F.lit, ("08:00", "14:00", "20:00"))), F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))
    return doses.withColumn("id", F.concat_ws(":", "user_id", F.date_format("day", "yyyy-MM-dd"), "slot"))


_DOSES = """doses AS (SELECT user_id, day, slot, user_id || ':' || strftime(day, '%Y-%m-%d') || ':' || slot AS id
  FROM (SELECT DISTINCT user_id FROM events), (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day), (VALUES ('08:00'), ('14:00'), ('20:00')) s(slot))"""
_LATEST = "latest AS (SELECT id, arg_max(status, (ts, event_id)) AS status FROM log GROUP BY id)"


@query(
    "q15_adherence_summary",
    f"""WITH {_LOG}, {_LATEST}, {_DOSES}, j AS (SELECT user_id, coalesce(status, 'pending') AS status FROM doses LEFT JOIN latest USING (id))
SELECT user_id, count(*) AS total, {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("taken", "pending", "skipped", "missed"))} FROM j GROUP BY user_id""",
)
def q15(spark, d):
    latest = dedupe.last_wins(_log(spark, d), ["id"], ["ts", "event_id"])
    return schedule.status_summary(schedule.with_status(_user_doses(spark, d), latest, "id"), "user_id")


@query(
    "q16_effective_status",
    """WITH e AS (SELECT event_id, date_diff('microsecond', ts, TIMESTAMP '2024-01-15 12:00:00') / 60000000.0 AS m, event_type FROM events)
SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type WHEN m > 45 THEN 'missed' ELSE 'pending' END AS status, (m BETWEEN 0 AND 45) AS due, (floor(-m) BETWEEN 0 AND 30) AS soon FROM e""",
)
def q16(spark, d):
    now, at = F.lit("2024-01-15 12:00:00").cast("timestamp"), F.col("ts").cast("timestamp")
    status = F.when(F.col("event_type") == "view", "pending").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", dates.effective_status(status, at, now).alias("status"), dates.due(at, now).alias("due"), dates.soon(at, now).alias("soon"))


@query(
    "q17_reminder_delta",
    """WITH d AS (SELECT event_id, stage, ts + to_minutes(CAST(stage AS BIGINT)) AS t FROM events, (VALUES (-30), (0), (15), (30), (45)) s(stage)),
want AS (SELECT event_id, stage FROM d WHERE t > TIMESTAMP '2024-01-29 00:00:00'), have AS (SELECT event_id, stage FROM d WHERE t > TIMESTAMP '2024-01-28 00:00:00' AND event_id % 3 <> 0)
SELECT event_id, stage, 'cancel' AS action FROM (SELECT * FROM have EXCEPT SELECT * FROM want) UNION ALL SELECT event_id, stage, 'create' FROM (SELECT * FROM want EXCEPT SELECT * FROM have)""",
)
def q17(spark, d):
    events = table(spark, d, "events").select("event_id", "ts")
    ahead = lambda now: schedule.reminders(events, F.col("ts"), F.lit(now).cast("timestamp_ntz"))
    have = ahead("2024-01-28 00:00:00").where("event_id % 3 <> 0").select("event_id", "stage")
    return dedupe.key_delta(have, ahead("2024-01-29 00:00:00").select("event_id", "stage"), ["event_id", "stage"])


@query(
    "q18_log_upsert",
    """WITH e AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN NULL ELSE props END AS note, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT user_id, event_type, arg_max_null(v, (ts, event_id)) AS v, arg_max(note, (ts, event_id)) AS note FROM e GROUP BY user_id, event_type""",
)
def q18(spark, d):
    log = table(spark, d, "events").withColumns({"note": F.when(F.col("event_id") % 4 != 0, F.col("props")), "v": F.when(F.col("event_id") % 5 != 0, F.col("value"))})
    return dedupe.upsert(log, ["user_id", "event_type"], ["ts", "event_id"], ["v"], ["note"])


@query(
    "q19_week_grid",
    f"""WITH {_LOG.replace(", ts FROM", ", user_id, ts FROM")}, g AS (SELECT user_id, date_trunc('week', ts)::DATE AS week, strftime(ts, '%Y-%m-%d') AS day,
  CASE WHEN hour(ts) BETWEEN 5 AND 10 THEN 'morning' WHEN hour(ts) BETWEEN 11 AND 13 THEN 'noon' WHEN hour(ts) BETWEEN 14 AND 17 THEN 'afternoon' ELSE 'evening' END AS period,
  count(*) AS n, {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("missed", "pending", "taken", "skipped"))} FROM log GROUP BY ALL)
SELECT user_id, strftime(week, '%Y-%m-%d') AS week, day, period, n, missed, pending, taken, skipped, CASE WHEN missed > 0 THEN 'missed ' || missed || '/' || n WHEN pending > 0 THEN 'pending ' || pending || '/' || n
  WHEN taken = n THEN 'taken' WHEN skipped = n THEN 'skipped' ELSE 'mixed' END AS label FROM g""",
)
def q19(spark, d):
    log = _log(spark, d).withColumn("user_id", F.split_part("id", F.lit(":"), F.lit(1)).cast("bigint")).withColumn("week", F.date_format(dates.week_start(F.col("ts")), "yyyy-MM-dd"))
    return schedule.week_grid(log, ["user_id", "week"], F.col("ts")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "q20_nested_items",
    """SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) FILTER (l_linenumber IS NOT NULL), '') AS items, count(l_linenumber) AS n
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
)
def q20(spark, d):
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("i"))
    joined = table(spark, d, "orders").select("o_orderkey").join(items, "o_orderkey", "left")
    shown = F.array_join(F.transform("i", lambda s: F.concat_ws(":", s["l_linenumber"], s["l_partkey"])), ",")
    return joined.select("o_orderkey", F.coalesce(shown, F.lit("")).alias("items"), F.coalesce(F.size("i"), F.lit(0)).cast("bigint").alias("n"))


@query(
    "q21_open_ranges",
    """WITH p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 200 END AS e, o_orderstatus <> 'F' AS active FROM orders)
SELECT o_orderkey, 'all' AS mode FROM p WHERE s <= DATE '1996-06-01' AND (e IS NULL OR e >= DATE '1996-06-01')
UNION ALL SELECT o_orderkey, 'active' FROM p WHERE s <= DATE '1996-06-01' AND (e IS NULL OR e >= DATE '1996-06-01') AND active""",
)
def q21(spark, d):
    day = F.lit("1996-06-01").cast("date")
    start = F.to_date("o_orderdate")
    plans = table(spark, d, "orders").select("o_orderkey", start.alias("start_date"), F.when(F.col("o_orderkey") % 4 != 0, F.date_add(start, 200)).alias("end_date"), (F.col("o_orderstatus") != "F").alias("is_active"))
    every, current = schedule.active_on(plans, day), schedule.active_on(plans, day, include_inactive=False)
    return every.select("o_orderkey", F.lit("all").alias("mode")).union(current.select("o_orderkey", F.lit("active")))


@query(
    "q22_joined_page",
    """SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND c_mktsegment = 'BUILDING'
ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
)
def q22(spark, d):
    orders = table(spark, d, "orders").where("o_orderdate >= timestamp_ntz '1997-01-01' AND o_orderdate < timestamp_ntz '1998-01-01'")
    customer = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return quality.page(orders.join(customer, "o_custkey").select("o_orderkey", "c_name", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 1, 100, 100)


_ITEMS = """items AS (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS session, event_type AS key, CASE WHEN value >= 50 THEN 'confirmed' ELSE 'unmapped' END AS status,
  value / 100 AS confidence, (event_id % 97) / 97.0 AS score, CASE WHEN event_id % 3 = 0 THEN '' ELSE props END AS text, CASE WHEN value < 5 THEN 'REJECT' ELSE 'GOOD' END AS quality, ts, event_id FROM events)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("session"),
        F.col("event_type").alias("key"),
        F.when(F.col("value") >= 50, "confirmed").otherwise("unmapped").alias("status"),
        (F.col("value") / 100).alias("confidence"),
        (F.col("event_id") % 97 / 97.0).alias("score"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("props")).alias("text"),
        F.when(F.col("value") < 5, "REJECT").otherwise("GOOD").alias("quality"),
        "ts",
        "event_id",
    )


@query(
    "q23_session_merge",
    f"""WITH {_ITEMS} SELECT session, key, count(*) AS frequency, round(max(confidence), 6) AS confidence, round(max(score), 6) AS score,
  CASE WHEN bool_or(status = 'confirmed') THEN 'confirmed' ELSE 'unmapped' END AS status, arg_min(text, (ts, event_id)) FILTER (text <> '') AS text, string_agg(DISTINCT quality, ',' ORDER BY quality) AS qualities FROM items GROUP BY session, key""",
)
def q23(spark, d):
    return sessions.merge_items(_items(spark, d), "session", "key", ["ts", "event_id"]).withColumns({"confidence": F.round("confidence", 6), "score": F.round("score", 6)})


@query(
    "q24_last_three_bad",
    """WITH r AS (SELECT user_id, event_type IN ('error', 'view') AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id FROM r WHERE n <= 3 GROUP BY user_id HAVING count(*) = 3 AND bool_and(bad)""",
)
def q24(spark, d):
    return sessions.all_of_last(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 3, F.col("event_type").isin("error", "view"))


@query(
    "q25_signatures",
    f"""WITH {_ITEMS}, m AS (SELECT session, key, CASE WHEN bool_or(status = 'confirmed') THEN 'confirmed' ELSE 'unmapped' END AS status FROM items WHERE quality <> 'REJECT' GROUP BY session, key)
SELECT session, string_agg(key || ':' || status, '|' ORDER BY key || ':' || status) AS signature FROM m GROUP BY session""",
)
def q25(spark, d):
    merged = sessions.merge_items(_items(spark, d).where("quality <> 'REJECT'"), "session", "key", ["ts", "event_id"])
    return sessions.signature(merged, "session", "key")


@query(
    "q26_rate_windows",
    """SELECT user_id, strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1""",
)
def q26(spark, d):
    counted = table(spark, d, "events").groupBy("user_id", F.window("ts", "15 minutes").alias("w")).agg(F.count("*").alias("n")).where("n > 1")
    return counted.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(
    "q27_gap_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM g)
SELECT user_id, session_no, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session_no""",
)
def q27(spark, d):
    split = sessions.by_gap(table(spark, d, "events"), ["user_id"], "ts", ["ts", "event_id"], 720)
    return split.groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_BANK = "bank AS (SELECT label AS candidate, embedding AS r FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n <= 10)"
_SCORED = f"""{_BANK}, b AS (SELECT vec_id, label, candidate, max(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(r AS DOUBLE[]))) AS base FROM embeddings, bank GROUP BY ALL),
c AS (SELECT vec_id, label, candidate, round(greatest(0, least(1, base)), 4) AS score FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, candidate) AS rank FROM c)"""


def _scored(spark: SparkSession, d: str, k: int) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return matching.score_candidates(vectors, matching.reference_bank(vectors, "label", "vec_id", 10), "vec_id", "embedding", "label", k)


@query("q28_vector_candidates", f"WITH {_SCORED} SELECT vec_id, candidate, score, rank FROM k WHERE rank <= 3")
def q28(spark, d):
    return _scored(spark, d, 3).select("vec_id", "candidate", "score", "rank")


_EXTRA = f"""{_SCORED}, t AS (SELECT vec_id, candidate, score, CASE WHEN score >= 0.4 THEN 'assigned' WHEN score >= 0.3 THEN 'uncertain' ELSE 'unknown' END AS status FROM k WHERE rank = 1),
x AS (SELECT *, row_number() OVER (PARTITION BY candidate, status ORDER BY score DESC, vec_id) AS n FROM t), e AS (SELECT vec_id, candidate, score, CASE WHEN status = 'assigned' AND n > 20 THEN 'extra' ELSE status END AS status FROM x)"""


def _marked(spark: SparkSession, d: str) -> DataFrame:
    first = _scored(spark, d, 1).drop("rank").withColumns({"status": numeric.match_status(F.col("score"), 0.4, 0.3), "expected": F.lit(20)})
    return matching.mark_extra(first, "candidate", "expected", [F.desc("score"), F.col("vec_id")])


@query("q29_extra_rule", f"WITH {_EXTRA} SELECT vec_id, candidate, score, status FROM e")
def q29(spark, d):
    return _marked(spark, d).select("vec_id", "candidate", "score", "status")


@query(
    "q30_assignment_summary",
    f"""WITH {_EXTRA}, l AS (SELECT DISTINCT label FROM embeddings)
SELECT label, 20 AS expected, count(*) FILTER (status = 'assigned') AS assigned, count(*) FILTER (status = 'extra') AS extra, greatest(20 - count(*) FILTER (status = 'assigned'), 0) AS missing FROM l LEFT JOIN e ON label = candidate GROUP BY label""",
)
def q30(spark, d):
    wanted = table(spark, d, "embeddings").select("label").distinct().withColumn("expected", F.lit(20))
    return matching.count_summary(wanted, _marked(spark, d).withColumnRenamed("candidate", "label"), "label", "expected")


@query("q31_uncovered", "SELECT doc_id, drug_key FROM documents d WHERE drug_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM drug_db_vn v WHERE lower(v.generic_name) = d.drug_key)")
def q31(spark, d):
    have = table(spark, d, "drug_db_vn").select(F.lower("generic_name").alias("drug_key")).distinct()
    return matching.uncovered(table(spark, d, "documents").where("drug_key IS NOT NULL").select("doc_id", "drug_key"), have, "drug_key").select("doc_id", "drug_key")


@query("q32_top1_accuracy", f"WITH {_SCORED} SELECT label, count(*) AS n, count(*) FILTER (label = candidate) AS hits, round(count(*) FILTER (label = candidate) / count(*), 6) AS accuracy FROM k WHERE rank = 1 GROUP BY label")
def q32(spark, d):
    truth = table(spark, d, "embeddings").select("vec_id", "label")
    return matching.top1_accuracy(_scored(spark, d, 1).join(truth, "vec_id"), "label", "candidate")


@query(
    "q35_profile_merge",
    """WITH r AS (SELECT lower(trim(brand)) AS key, coalesce(trust_rank, 99) AS rank, id, color, shape FROM drug_db d LEFT JOIN source_trust t ON lower(trim(d.source)) = t.source WHERE trim(brand) <> '')
SELECT key, arg_min(color, (rank, id)) FILTER (trim(color) <> '') AS color, arg_min(shape, (rank, id)) FILTER (trim(shape) <> '') AS shape FROM r GROUP BY key""",
)
def q35(spark, d):
    trust = table(spark, d, "source_trust").withColumnRenamed("source", "s")
    rows = table(spark, d, "drug_db").where("trim(brand) <> ''").join(F.broadcast(trust), F.lower(F.trim("source")) == F.col("s"), "left")  # a fixed table
    ranked = rows.select(F.lower(F.trim("brand")).alias("key"), F.struct(F.coalesce("trust_rank", F.lit(99)), "id").alias("rank"), "color", "shape")
    return profiles.merge_first_filled(ranked, "key", "rank", ["color", "shape"])


@query("q36_distribution", "SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM documents GROUP BY lang")
def q36(spark, d):
    return quality.distribution(table(spark, d, "documents"), "lang")


_CHECKED = (("drug_db", "id", ("name", "usage", "side_effects", "source")), ("documents", "doc_id", ("text", "source")), ("drug_db_vn", "row_id", ("brand_name", "generic_name", "dosage")))


@query(
    "q37_quality_checks",
    " UNION ALL ".join(
        f"SELECT '{t}' AS tbl, 'rows' AS \"check\", CAST(count(*) AS DOUBLE) AS value FROM {t} UNION ALL SELECT '{t}', 'keys', CAST(count(DISTINCT {k}) AS DOUBLE) FROM {t}"
        + "".join(f" UNION ALL SELECT '{t}', 'filled_{c}', round(avg(CASE WHEN trim(coalesce(\"{c}\", '')) <> '' THEN 1.0 ELSE 0.0 END), 6) FROM {t}" for c in cols)
        for t, k, cols in _CHECKED
    ),
)
def q37(spark, d):
    parts = [quality.profile(table(spark, d, t), t, cols, k) for t, k, cols in _CHECKED]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    "q38_precision_recall",
    """WITH t AS (SELECT contains(lower(text), lower(drug_key)) AS p, coalesce(source, '') = 'leaflet' AS y FROM documents WHERE text IS NOT NULL AND drug_key IS NOT NULL),
c AS (SELECT count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn FROM t)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
)
def q38(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL AND drug_key IS NOT NULL")
    return quality.precision_recall(docs, F.lower("text").contains(F.lower("drug_key")), F.coalesce("source", F.lit("")) == "leaflet")


@query(
    "q39_bio_tags",
    """WITH b AS (SELECT row_id, list_filter(regexp_split_to_array(brand_name, '\\s+'), lambda x: x <> '') AS w, coalesce(category, '') <> '' AS drug FROM drug_db_vn WHERE brand_name IS NOT NULL),
p AS (SELECT row_id, drug, w, unnest(range(0, len(w))) AS pos FROM b)
SELECT row_id, CAST(pos AS INTEGER) AS pos, w[pos + 1] AS token, CASE WHEN NOT drug THEN 'O' WHEN pos = 0 THEN 'B-DRUG' ELSE 'I-DRUG' END AS tag FROM p""",
)
def q39(spark, d):
    rows = table(spark, d, "drug_db_vn").where("brand_name IS NOT NULL")
    return profiles.bio_tags(rows, "row_id", F.col("brand_name"), F.coalesce("category", F.lit("")) != "")


_BLOCKS = """blocks AS (SELECT coalesce(CAST(user_id AS VARCHAR), '?') || ':' || coalesce(strftime(ts, '%Y-%m-%d'), '?') AS page, event_id AS block, hour(ts) * 60 + minute(ts) AS x1, hour(ts) * 60 + minute(ts) + 1 + event_id % 60 AS x2,
  (event_id * 7) % 500 AS y1, (event_id * 7) % 500 + 10 + event_id % 30 AS y2 FROM events)"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """All events as boxes; a page is a user's day."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    page = F.concat_ws(":", part(F.col("user_id")), part(F.to_date("ts")))
    x, y = F.hour("ts") * 60 + F.minute("ts"), F.col("event_id") * 7 % 500
    return table(spark, d, "events").select(page.alias("page"), F.col("event_id").alias("block"), x.cast("bigint").alias("x1"), (x + 1 + F.col("event_id") % 60).alias("x2"), y.alias("y1"), (y + 10 + F.col("event_id") % 30).alias("y2"))


@query(
    "q40_gaps",
    f"""WITH {_BLOCKS}, e AS (SELECT *, max(x2) OVER (PARTITION BY page ORDER BY x1, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM blocks),
g AS (SELECT page, edge, x1 AS next, x1 - edge AS gap, (x1 + edge) / 2 AS centre FROM e WHERE x1 > edge), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY gap DESC, centre) AS rank FROM g)
SELECT page, edge, next, gap, centre, rank FROM r WHERE rank <= 3""",
)
def q40(spark, d):
    return layout.gaps(_blocks(spark, d), "page", "x1", "x2", ["block"], 3)


@query(
    "q41_nearest_anchor",
    f"""WITH {_BLOCKS}, a AS (SELECT page, block AS anchor, y1 AS ay FROM blocks WHERE block % 5 = 0), m AS (SELECT *, (ay + lead(ay) OVER (PARTITION BY page ORDER BY ay, anchor)) / 2 AS hi, row_number() OVER (PARTITION BY page ORDER BY ay, anchor) AS n FROM a)
SELECT b.page, b.block, arg_min(anchor, n) FILTER (b.y1 <= coalesce(hi, 1e18)) AS anchor FROM blocks b LEFT JOIN m ON b.page = m.page GROUP BY b.page, b.block""",
)
def q41(spark, d):
    return _anchored(_blocks(spark, d))


def _anchored(blocks: DataFrame) -> DataFrame:
    anchors = blocks.where("block % 5 = 0").select("page", F.col("block").alias("anchor"), F.col("y1").alias("ay"))
    return layout.nearest_anchor(blocks.select("page", "block", "y1"), anchors, "page", "y1", "ay", "anchor").select("page", "block", "anchor")


@query(
    "q42_neighbours",
    f"""WITH {_BLOCKS}, p AS (SELECT a.page, a.block AS src, b.block AS dst, a.x1 AS ax1, a.x2 AS ax2, a.y1 AS ay1, a.y2 AS ay2, b.x1 AS bx1, b.x2 AS bx2, b.y1 AS by1, b.y2 AS by2 FROM blocks a JOIN blocks b ON a.page = b.page AND a.block <> b.block),
c AS (SELECT page, src, dst, 'right' AS dir, bx1 AS d FROM p WHERE greatest(ay1, by1) < least(ay2, by2) AND bx1 >= ax2 UNION ALL SELECT page, src, dst, 'below', by1 FROM p WHERE greatest(ax1, bx1) < least(ax2, bx2) AND by1 >= ay2),
r AS (SELECT *, row_number() OVER (PARTITION BY page, src, dir ORDER BY d, dst) AS n FROM c) SELECT page, src, dst, dir FROM r WHERE n = 1""",
)
def q42(spark, d):
    return layout.neighbours(_blocks(spark, d), "page", "block", "x1", "x2", "y1", "y2")


@query("q43_consensus")
def q43(spark, d):
    """Votes over the sample texts of each product; rows only, as clusters depend on order."""
    samples = table(spark, d, "vaipe_drugs_kb").select("id", F.posexplode("sample_texts").alias("image", "text")).withColumn("confidence", F.lit(0.9))
    return profiles.consensus(samples, "id", "image", "text", "confidence")


def _case(column: str, mapping: dict[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, '{k}') THEN '{v}'" for k, v in mapping.items()) + f" ELSE {otherwise} END"


@query("q44_keyword_maps", f"SELECT id, {_case('lower(trim(dosage))', rules.SHAPES, "''")} AS shape FROM drug_db WHERE dosage IS NOT NULL")
def q44(spark, d):
    return table(spark, d, "drug_db").where("dosage IS NOT NULL").select("id", rules.shape_of_form(F.col("dosage")).alias("shape"))


@query(
    "q45_alias_shaping",
    """SELECT event_id, coalesce(nullif(trim(json_extract_string(props, '$.key')), ''), nullif(trim(json_extract_string(props, '$.k')), ''), '') AS label,
  coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), -1) AS k, CASE WHEN json_extract_string(props, '$.name') IS NULL THEN 'unmapped' ELSE 'confirmed' END AS status FROM events""",
)
def q45(spark, d):
    p = F.from_json("props", "struct<key:string,k:string,name:string>")
    rows = table(spark, d, "events").select("event_id", p.alias("p"))
    label = text.first_filled(F.col("p.key"), F.col("p.k"))
    return rows.select("event_id", label.alias("label"), numeric.number_or(F.col("p.k"), -1.0).alias("k"), F.when(F.col("p.name").isNull(), "unmapped").otherwise("confirmed").alias("status"))


@query(
    "q46_nested_filter",
    """WITH k AS (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem)
SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_discount >= 0.05) AS kept, CAST(coalesce(sum(greatest(1, CAST(l_quantity AS BIGINT))) FILTER (l_discount >= 0.05), 0) AS BIGINT) AS units FROM k GROUP BY l_orderkey""",
)
def q46(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.struct("l_linenumber", "l_quantity", "l_discount")).alias("items"))
    kept = F.filter("items", lambda i: i["l_discount"] >= 0.05)
    units = F.aggregate(kept, F.lit(0).cast("bigint"), lambda s, i: s + F.greatest(F.lit(1), i["l_quantity"].cast("bigint")))
    return lines.select("l_orderkey", F.size("items").cast("bigint").alias("n"), F.size(kept).cast("bigint").alias("kept"), units.alias("units"))


@query(
    "q47_relational_core",
    """SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS tier FROM orders JOIN customer ON o_custkey = c_custkey
WHERE (o_orderstatus IN ('F', 'O') AND c_name ILIKE '%customer#00000%') AND (o_totalprice > 200000 OR o_orderpriority = '1-URGENT') AND c_acctbal IS NOT NULL AND o_orderdate > TIMESTAMP '1994-01-01'""",
)
def q47(spark, d):
    price = (F.col("o_totalprice") > 200000) | (F.col("o_orderpriority") == "1-URGENT")
    orders = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O") & price & F.expr("o_orderdate > timestamp_ntz '1994-01-01'"))
    customer = table(spark, d, "customer").where(F.col("c_name").ilike("%customer#00000%") & F.col("c_acctbal").isNotNull()).select(F.col("c_custkey").alias("o_custkey"))
    tier = rules.cascade([(F.col("o_orderpriority") == "1-URGENT", 0), (F.col("o_orderpriority") == "2-HIGH", 1)], 2)
    return orders.join(customer, "o_custkey").select("o_orderkey", "o_orderpriority", tier.alias("tier"))


@query(
    "q48_hierarchy",
    """SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(l_linenumber) AS lines FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey
LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name <> 'ASIA') GROUP BY n_name""",
)
def q48(spark, d):
    nations = table(spark, d, "nation").join(table(spark, d, "region").where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    # Lines are counted per order, orders per customer, before each join up: no join multiplies rows.
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    orders = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"))
    customers = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("orders").alias("orders"), F.sum("lines").alias("lines"))
    return nations.join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("customers", "orders", "lines")])


_CUT = "SELECT o_custkey, sha256(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey)) AS digest FROM orders WHERE o_orderdate < TIMESTAMP '{}' GROUP BY o_custkey"


@query(
    "q49_snapshot_changes",
    f"""WITH a AS ({_CUT.format("1997-01-01")}), b AS ({_CUT.format("1997-07-01")})
SELECT o_custkey, CASE WHEN a.digest IS NULL THEN 'added' WHEN b.digest IS NULL THEN 'removed' WHEN a.digest = b.digest THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b USING (o_custkey)""",
)
def q49(spark, d):
    def cut(day: str) -> DataFrame:
        held = table(spark, d, "orders").where(f"o_orderdate < timestamp_ntz '{day}'")
        return held.groupBy("o_custkey").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda s: F.concat_ws(":", s["o_orderkey"], s["o_orderstatus"])), ","), 256).alias("digest"))

    return dedupe.snapshot_changes(cut("1997-01-01"), cut("1997-07-01"), ["o_custkey"])


@query(
    "q50_variant_fallback",
    """WITH v AS (SELECT id, name, brand FROM vaipe_drugs_kb), x AS (SELECT id, 0 AS k, lower(trim(brand)) AS variant FROM v UNION ALL SELECT id, 1, lower(trim(regexp_replace(name, '-.*$', ''))) FROM v UNION ALL SELECT id, 2, lower(trim(name)) FROM v),
l AS (SELECT lower(brand_name) AS n, brand_name AS entry FROM brand_list UNION ALL SELECT lower(name), name FROM ingredient_list), h AS (SELECT id, k, entry, row_number() OVER (PARTITION BY id ORDER BY k, entry) AS r FROM x JOIN l ON variant = n)
SELECT id, k, entry FROM h WHERE r = 1""",
)
def q50(spark, d):
    kb = table(spark, d, "vaipe_drugs_kb")
    forms = F.array(F.lower(F.trim("brand")), F.lower(F.trim(F.regexp_replace("name", "-.*$", ""))), F.lower(F.trim("name")))
    variants = kb.select("id", F.posexplode(forms).alias("k", "variant")).where("variant IS NOT NULL")
    names = table(spark, d, "brand_list").select(F.col("brand_name").alias("entry")).union(table(spark, d, "ingredient_list").select("name"))
    return resolve.variant_fallback(variants, "id", "variant", "k", names, "entry").select("id", "k", "entry")


@query(
    "q51_domain_order",
    """WITH r AS (SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY CASE status WHEN 'assigned' THEN 0 WHEN 'uncertain' THEN 1 ELSE 2 END, confidence DESC NULLS LAST, id) AS place, (coalesce(status, '') <> 'assigned' OR coalesce(confidence, 0) < 0.85) AS needs_review
FROM (SELECT DISTINCT id, session_id, status, CASE WHEN isnan(confidence) THEN NULL ELSE confidence END AS confidence FROM dose_verification_detections WHERE session_id IS NOT NULL)) SELECT id, session_id, place, needs_review FROM r""",
)
def q51(spark, d):
    rows = table(spark, d, "dose_verification_detections").where("session_id IS NOT NULL")
    rows = rows.select("id", "session_id", "status", F.nullif(F.col("confidence"), F.lit(float("nan"))).alias("confidence")).distinct()
    order = [rules.cascade([(F.col("status") == "assigned", 0), (F.col("status") == "uncertain", 1)], 2), F.desc_nulls_last("confidence"), F.col("id")]
    review = (F.coalesce("status", F.lit("")) != "assigned") | (F.coalesce("confidence", F.lit(0.0)) < 0.85)
    return dedupe.top_per_group(rows, ["session_id"], order, 2**31 - 1, "place").select("id", "session_id", "place", review.alias("needs_review"))


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda x: x <> ''))"


@query(
    "q52_set_algebra",
    f"""WITH t AS (SELECT id, {_TOKENS.format("name")} AS a, {_TOKENS.format("brand")} AS b FROM drug_db)
SELECT id, len(a) AS n_a, len(list_distinct(list_concat(a, b))) AS n_union, len(list_intersect(a, b)) AS n_both, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS n_only, list_has_any(a, b) AS meets FROM t""",
)
def q52(spark, d):
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))
    rows = table(spark, d, "drug_db").select("id", tokens("name").alias("a"), tokens("brand").alias("b"))
    n = lambda c: F.size(c).cast("bigint")
    return rows.select("id", n("a").alias("n_a"), n(F.array_union("a", "b")).alias("n_union"), n(F.array_intersect("a", "b")).alias("n_both"), n(F.array_except("a", "b")).alias("n_only"), F.arrays_overlap("a", "b").alias("meets"))


@query("q53_reference_bank", "SELECT label, vec_id, n AS place FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n <= 10")
def q53(spark, d):
    return dedupe.top_per_group(table(spark, d, "embeddings").select("label", "vec_id"), ["label"], [F.col("vec_id")], 10, "place")


@query(
    "q54_previews",
    f"""WITH one AS (SELECT DISTINCT l_orderkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey), g AS (SELECT l_orderkey, list(p_name ORDER BY p_name) AS names FROM one GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN ' + ' || (len(names) - 3) || ' more' ELSE '' END AS preview FROM g""",
)
def q54(spark, d):
    names = _names(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_name")).alias("names"))
    more = F.when(F.size("names") > 3, F.concat(F.lit(" + "), (F.size("names") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return names.select("l_orderkey", F.concat(F.array_join(F.slice("names", 1, 3), ", "), more).alias("preview"))


@query(
    "q55_threshold_rules",
    """SELECT id, CASE WHEN q < 0.2 THEN 'REJECT' WHEN q < 0.4 THEN 'WARNING' ELSE 'GOOD' END AS state FROM (SELECT id, quality_score AS q FROM pill_reference_images WHERE quality_score IS NOT NULL AND NOT isnan(quality_score))""",
)
def q55(spark, d):
    q = F.col("quality_score")
    rows = table(spark, d, "pill_reference_images").where(q.isNotNull() & ~F.isnan(q))
    return rows.select("id", rules.cascade([(q < 0.2, "REJECT"), (q < 0.4, "WARNING")], "GOOD").alias("state"))


@query(
    "q56_name_keys",
    """SELECT id, trim(regexp_replace(strip_accents(replace(lower(name), 'đ', 'd')), '[^a-z0-9]+', ' ', 'g')) AS key, regexp_replace(lower(trim(name)), '[^a-z0-9]', '', 'g') AS ascii_key FROM drug_db""",
)
def q56(spark, d):
    return table(spark, d, "drug_db").select("id", text.name_key(F.col("name")).alias("key"), text.ascii_key(F.col("name")).alias("ascii_key"))
