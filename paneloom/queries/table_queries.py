"""Cleaning, joins, duplicates, filters, summaries and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.functions import dates, maths, text
from paneloom.operators import cleaning, dedupe, filters, joins, summary
from paneloom.operators.spread import settle
from paneloom.plans import orders_panel as op
from paneloom.plans.league import split_schedule
from paneloom.queries.base import WITH, big, query, r
from paneloom.schema import ORDERS_EXPORT
from paneloom.session import shared_folder
from paneloom.sources import delimited, history, listing, stages

# ------------------------------------------------ joins and set operations

_FLAG_SQL = """ AS (SELECT l_orderkey AS k, l_quantity AS qty, l_tax AS tax FROM lineitem WHERE l_returnflag = '{f}'
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_tax) = 1)"""


@query(
    "D4 B9 E2 E1",
    "WITH " + ", ".join(f"t{f}" + _FLAG_SQL.format(f=f) for f in "ANR")
    + """, an AS (SELECT coalesce(tA.k, tN.k) AS k, tA.qty AS qty, tA.tax AS taxA, tN.tax AS taxN
      FROM tA FULL JOIN tN ON tA.k = tN.k)
    SELECT coalesce(an.k, tR.k) AS "key", an.qty AS qty, taxA AS "tax_A", taxN AS "tax_N", tR.tax AS "tax_R"
      FROM an FULL JOIN tR ON an.k = tR.k""",
)
def stat_tables_outer_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line of each order per return flag, set side by side; the shared quantity is the first table's."""
    lines = op.table(spark, sf_dir, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax"]
    firsts = dedupe.keep_first(lines, ["l_returnflag", "l_orderkey"], order)
    tables = []
    for flag in ("A", "N", "R"):
        part = firsts.where(F.col("l_returnflag") == flag).select(
            F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("qty"), F.col("l_tax").alias("tax")
        )
        tables.append(cleaning.suffix_columns(part, flag, ["key", "qty"]))
    return joins.outer_concat(tables, "key")


@query(
    "E2",
    """SELECT user_id, event_type, event_id, value FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
)
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = op.table(spark, sf_dir, "events")
    first = dedupe.keep_first(events, ["user_id", "event_type"], ["ts", "event_id"])
    return first.select("user_id", "event_type", "event_id", "value")


@query(
    "E3",
    """SELECT CAST(o_orderdate AS DATE) AS day, o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY ALL""",
)
def dedup_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = op.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_custkey", "o_orderkey")
    first = dedupe.keep_first(orders, ["day", "o_custkey"], ["o_orderkey"])
    return first.withColumnRenamed("o_orderkey", "first_order")


@query(
    "E4",
    'SELECT sha256(text) AS digest, count(*) AS "count" FROM documents GROUP BY 1 HAVING count(*) > 1',
)
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the same text: the digest travels, not the text."""
    documents = op.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"))
    return dedupe.duplicate_keys(documents, ["digest"])


@query("E6", "SELECT DISTINCT source FROM documents")
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.distinct_values(op.table(spark, sf_dir, "documents"), "source")


@query(
    "E1",
    """SELECT 'customer' AS kind, c_custkey AS "key", c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
      UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""",
)
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = op.table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("segment"),
    )
    suppliers = op.table(spark, sf_dir, "supplier").select(
        F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("acctbal")
    )
    return dedupe.union_all([customers, suppliers])


@query(
    "D6 D7",
    """SELECT o_orderkey, c_name AS customer, c_acctbal AS balance FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def value_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = op.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = op.table(spark, sf_dir, "customer")
    named = joins.look_up(orders, "o_custkey", customers, "c_custkey", "c_name", "customer")
    balances = customers.select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("balance"))
    return joins.join_unique(named, balances, ["o_custkey"], "inner").drop("o_custkey")


@query(
    "D1",
    """SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey
      GROUP BY c_custkey""",
)
def left_join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = op.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    customers = op.table(spark, sf_dir, "customer").select("c_custkey")
    return cleaning.fill_typed(joins.join_unique(customers, counts, ["c_custkey"], on_duplicate="ignore"), {"orders": 0})


@query(
    "D5",
    "SELECT s_suppkey, n_name AS nation FROM supplier JOIN nation ON n_nationkey = s_nationkey",
)
def mapped_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = op.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("nation"))
    nations = op.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("code"), "n_name")
    return joins.map_or_raise(suppliers, "nation", nations, "code", "n_name")


@query(
    "D8 C4",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS season, c_mktsegment AS segment FROM orders
      JOIN customer ON c_custkey = o_custkey WHERE year(o_orderdate) IN (1996, 1998)
      AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 5000""",
)
def membership_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = op.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), "c_acctbal"
    )
    wanted = filters.keep_members(customers, "segment", ["building", "machinery", "unknown"], fold="upper")
    orders = op.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", op.season().alias("season"))
    orders = filters.keep_members(orders, "season", [1996, 1998, 2050])
    kept = joins.keep_keys(orders, wanted.where("c_acctbal > 5000"), ["o_custkey"])
    return kept.join(wanted, "o_custkey").select("o_orderkey", big("season"), "segment")


@query(
    "D8",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def customers_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = op.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.drop_keys(op.table(spark, sf_dir, "customer").select("c_custkey"), pending, ["c_custkey"])


# ------------------------------------------------ filters

@query(
    "C10",
    "SELECT event_id, event_type FROM events WHERE event_id > "
    "(SELECT min(event_id) FROM events WHERE event_type = 'purchase' AND value > 100)",
)
def marker_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = op.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    marker = (F.col("event_type") == "purchase") & (F.col("value") > 100)
    return filters.split_at_marker(events, "event_id", marker, after=True).select("event_id", "event_type")


@query(
    "C10",
    "SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE event_id < "
    "(SELECT min(event_id) FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-17')",
)
def date_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = op.table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"))
    return filters.split_at_marker(events, "event_id", F.col("day") == F.lit("2024-01-17").cast("date"))


@query(
    "C5",
    WITH + 'SELECT player_season_team, "G" FROM panel WHERE "FGA_per_game" >= 2 AND "MP" >= 28 AND "G" <= 3',
)
def absolute_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.at_least(op.panel(spark, sf_dir), {"FGA_per_game": 2, "MP": 28})
    return filters.at_most(rows, {"G": 3}).select("player_season_team", "G")


@query(
    "C6 F3",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice FROM (
      SELECT *, max(l_extendedprice) OVER (PARTITION BY l_suppkey) AS peak FROM lineitem)
      WHERE l_extendedprice >= peak * 0.6::DOUBLE""",
)
def group_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = op.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    kept = filters.group_threshold(lines, "l_suppkey", "l_extendedprice", 0.6)
    return kept.select("l_orderkey", big("l_linenumber"), "l_extendedprice")


@query(
    "C7 I2",
    """SELECT CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) > 9 THEN 1 ELSE 0 END AS BIGINT) AS season,
      count(*) AS orders FROM orders GROUP BY 1 HAVING season < 2001""",
)
def season_roll_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = op.table(spark, sf_dir, "orders").select(dates.season_of(F.col("o_orderdate")).cast("long").alias("season"))
    return orders.where("season < 2001").groupBy("season").agg(F.count(F.lit(1)).alias("orders"))


@query(
    "C1 C2 C3",
    """SELECT conv_id, turn, role FROM conversations WHERE role IS DISTINCT FROM 'system'
      AND NOT contains(text, 'tion') AND conv_id IS NOT NULL AND turn IS NOT NULL""",
)
def noise_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.table(spark, sf_dir, "conversations")
    rows = filters.drop_header_repeats(rows, "role", "system")
    return filters.drop_containing(filters.drop_incomplete(rows), "text", "tion").select("conv_id", "turn", "role")


# ------------------------------------------------ cleaning

@query(
    "B6 B7 B16 I1",
    """SELECT p_partkey, regexp_replace(p_name, '[ _''.*]', '', 'g') AS clean,
      regexp_replace(upper(p_brand), '[^A-Z]', '', 'g') AS letters,
      replace(regexp_replace(p_type || '_size_advanced', '_advanced$', ''), '_', ' ') AS label FROM part""",
)
def name_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.table(spark, sf_dir, "part").select(
        "p_partkey",
        text.clean_name(F.col("p_name")).alias("clean"),
        text.letters_only(F.col("p_brand")).alias("letters"),
        text.feature_label(F.concat("p_type", F.lit("_size_advanced"))).alias("label"),
    )


@query(
    "B20 B16",
    """SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, CASE upper(replace(r_name, ' ', '_')) WHEN 'EAST' THEN 'EASTERN_CONF'
      ELSE upper(replace(r_name, ' ', '_')) || '_CONF' END AS "CONF" FROM region""",
)
def conference_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = op.table(spark, sf_dir, "region")
    label = text.conference_label(F.concat(F.initcap("r_name"), F.lit(" Conference")))
    return regions.select(big("r_regionkey"), label.alias("CONF"))


@query(
    "B10 B11 B13",
    """SELECT l_suppkey AS suppkey, count(*) FILTER (l_returnflag = 'R') AS "R",
      coalesce(sum(l_quantity) FILTER (l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity > 45), 0.0) AS "3P_A",
      coalesce(sum(l_quantity) FILTER (l_returnflag = 'N' AND l_linestatus = 'F' AND l_quantity > 49.5), 0.0) AS "3P_N"
      FROM lineitem GROUP BY 1""",
)
def wide_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = op.table(spark, sf_dir, "lineitem")

    def quantity(flag: str, above: float):
        chosen = (F.col("l_returnflag") == flag) & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > above)
        return F.sum(F.when(chosen, F.col("l_quantity")))

    wide = lines.groupBy(F.col("l_suppkey").alias("suppkey")).agg(
        F.count_if(F.col("l_returnflag") == "R").cast("string").alias("R"),
        quantity("A", 45).alias("3P_A"),
        quantity("N", 49.5).alias("3P_N"),
        F.max(F.when(F.col("l_quantity") < 0, F.col("l_tax"))).alias("nothing"),
    )
    kept = cleaning.drop_empty_columns(settle(wide))
    return cleaning.cast_columns(cleaning.fill_by_prefix(kept, "3P"), {"R": "long"})


@query(
    "C12",
    WITH + """SELECT unnest(CASE WHEN (SELECT count(*) FROM panel WHERE "RET_advanced" = 0) > 0
      THEN ['MP', 'PTS_per_game'] ELSE ['MP', 'PTS_per_game', 'RET_advanced'] END) AS feature""",
)
def non_null_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.panel(spark, sf_dir).withColumn("RET_advanced", F.expr("nullif(RET_advanced, 0)"))
    names = cleaning.complete_columns(rows, ["MP", "PTS_per_game", "RET_advanced"])
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query(
    "I5 I6 I7 I3 K2",
    """SELECT o_orderkey, round(ln(o_totalprice + 1), 6) AS logged, round(exp(o_totalprice / 1000000), 6) AS raised,
      greatest(o_totalprice - 100000, 0) AS clamped FROM orders""",
)
def log_exp_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    done = op.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        maths.log_transform(price).alias("logged"),
        maths.exp_transform(price / 1000000).alias("raised"),
        maths.clamp_at_zero(price - 100000).alias("clamped"),
    )
    return done.select("o_orderkey", r("logged"), r("raised"), "clamped")


@query(
    "I1 I2 I3 I4 B19 H1",
    """SELECT event_id, upper(event_type) AS kind, date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') AS days,
      strftime(ts, '%m-%d-%Y') AS written, CAST(ts AS DATE) AS day, least(CAST(ts AS DATE), DATE '2024-01-15') AS capped,
      CASE WHEN event_type = 'error' THEN 'bad' ELSE 'good' END AS verdict,
      coalesce(CASE WHEN value BETWEEN 1 AND 3 THEN 'low' END, 'other') AS band,
      CAST(floor(value) AS BIGINT) AS whole FROM events""",
)
def scalar_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = op.table(spark, sf_dir, "events")
    marked = cleaning.label_where(events, F.col("event_type") == "error", "bad", "good", "verdict")
    day = dates.history_date(F.date_format("ts", dates.HISTORY_DATE))
    return marked.select(
        "event_id",
        F.upper("event_type").alias("kind"),
        F.datediff(F.lit("2024-02-01").cast("date"), day).cast("long").alias("days"),
        F.date_format("ts", "MM-dd-yyyy").alias("written"),
        day.alias("day"),
        dates.earlier_of(day, F.lit("2024-01-15").cast("date")).alias("capped"),
        "verdict",
        F.coalesce(F.when(F.col("value").between(1, 3), F.lit("low")), F.lit("other")).alias("band"),
        F.col("value").cast("int").cast("long").alias("whole"),
    )


# ------------------------------------------------ summaries

@query("F8", "SELECT min(o_totalprice) AS low, max(o_totalprice) AS high, count(o_totalprice) AS n FROM orders")
def column_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.column_range(op.table(spark, sf_dir, "orders"), "o_totalprice")


@query(
    "F4",
    """SELECT l_returnflag, round(avg(abs(l_discount - l_tax)), 6) AS mae,
      round(avg((l_discount - l_tax) * (l_discount - l_tax)), 6) AS mse, max(abs(l_discount - l_tax)) AS max_error
      FROM lineitem GROUP BY 1""",
)
def error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summary.error_metrics(op.table(spark, sf_dir, "lineitem"), "l_discount", "l_tax", ["l_returnflag"])
    return found.select("l_returnflag", r("mae"), r("mse"), "max_error")


# ------------------------------------------------ sources and sinks

@query(
    "A1 A2 A9",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
      o_orderpriority FROM orders""",
)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = op.table(spark, sf_dir, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    path = shared_folder(spark, "orders-csv")
    delimited.write_delimited(cleaning.keep_columns(orders, ORDERS_EXPORT.names), path, compression="gzip")
    back = delimited.read_delimited(spark, path, ORDERS_EXPORT)
    return back.unionByName(stages.read_or_empty(spark, f"{path}-absent", ORDERS_EXPORT))


@query(
    "A3",
    WITH + 'SELECT "SEASON", count(*) AS rows FROM panel GROUP BY ALL',
)
def stage_built_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second build is skipped: a complete stage from the same files by the same recipe is there."""
    path = shared_folder(spark, "stage")
    how = {
        "inputs": [op.table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "nation")],
        "recipe": "orders as a panel", "partition_by": ["SEASON"],
    }
    built = stages.build_once(spark, path, lambda: op.panel(spark, sf_dir), **how)
    again = stages.build_once(spark, path, lambda: built.limit(0), **how)
    return again.groupBy(big("SEASON")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "A7 E1",
    WITH + """SELECT "DATE", "PLAYER", "PRED" FROM daily WHERE "DATE" <= DATE '2024-01-20'
      UNION ALL SELECT "DATE", "PLAYER", "PRED" * 2 FROM daily WHERE "DATE" > DATE '2024-01-20'""",
)
def history_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping batches and a repeat of the second: dates that are known add nothing."""
    days = settle(op.daily_scores(spark, sf_dir))
    path = shared_folder(spark, "history")
    history.append_once(days.where("DATE <= '2024-01-20'"), path)
    later = days.where("DATE >= '2024-01-15'").withColumn("PRED", F.col("PRED") * 2)
    history.append_once(later, path)
    return history.append_once(later, path)


#: Records per rendered listing document, which bounds its size.
_PER_LISTING = 100


@query(
    "A8 I8",
    """SELECT event_type AS name, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS created,
      arg_max('u/' || event_id, (strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), 'u/' || event_id)) AS url
      FROM events WHERE value >= 10 GROUP BY 1""",
)
def latest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of JSON listings; the newest live record of each type."""
    record = F.struct(
        F.col("event_type").alias("name"),
        (F.col("value") < 10).alias("expired"),
        F.date_format("ts", listing.CREATED_AT).alias("created_at"),
        F.concat(F.lit("u/"), F.col("event_id").cast("string")).alias("archive_download_url"),
    )
    events = op.table(spark, sf_dir, "events")
    listed = events.groupBy(F.floor(F.col("event_id") / _PER_LISTING).alias("page")).agg(
        F.to_json(F.struct(F.count(F.lit(1)).alias("total_count"), F.collect_list(record).alias("artifacts"))).alias("json")
    )
    found = listing.latest_records(listing.listing_records(listed))
    return found.select("name", F.date_format("created", listing.CREATED_AT).alias("created"), "url")


@query(
    "J19 E3 C10 B3 B4",
    """WITH games AS (
      SELECT year(o_orderdate) AS season, o_orderkey AS "at", o_custkey, o_orderstatus, o_orderpriority,
        CAST(o_orderdate AS DATE) AS day,
        o_totalprice > 499900 AS marker FROM orders
      QUALIFY row_number() OVER (PARTITION BY year(o_orderdate), CASE WHEN marker THEN 'Playoffs' ELSE CAST(day AS VARCHAR) END,
        o_orderpriority, o_custkey ORDER BY o_orderkey) = 1
    ), marks AS (
      SELECT season, min("at") FILTER (marker) AS mark, bool_or(day = DATE '2000-05-15') AS started FROM games GROUP BY 1
    ) SELECT CAST(season AS BIGINT) AS "SEASON", day AS "DATE", CAST(o_custkey AS VARCHAR) AS "VISITOR",
        o_orderpriority AS "HOME"
      FROM games JOIN marks USING (season) WHERE NOT marker AND
        CASE WHEN season = 2000 THEN started AND day >= DATE '2000-05-15' ELSE coalesce("at" > mark, false) END""",
)
def schedule_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as games of a year; very large ones stand for the marker row, one year splits by date."""
    marker = F.col("o_totalprice") > 499900
    games = op.table(spark, sf_dir, "orders").select(
        op.season().alias("season"), F.col("o_orderkey").alias("at"),
        F.when(marker, F.lit("Playoffs")).otherwise(F.date_format("o_orderdate", "MMM d, yyyy")).alias("DATE"),
        F.col("o_custkey").cast("string").alias("VISITOR"), F.lit(1).alias("VISITOR_PTS"),
        F.col("o_orderpriority").alias("HOME"), F.lit(2).alias("HOME_PTS"),
    )
    games = dedupe.keep_first(games, ["season", "DATE", "HOME", "VISITOR"], ["at"])
    later = split_schedule(games, {2000: "2000-05-15"}, playoffs=True, date_format="MMM d, yyyy")
    return later.select(big("SEASON"), "DATE", "VISITOR", "HOME")
