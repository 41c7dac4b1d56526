"""Queries over the star schema and the events, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import analyses, delta, history, lines, relations, stats, store
from granary.plans.registry import query, table
from granary.session import shared_folder
from granary.streaming import board, content, ledger


def _numstat(spark, sf):
    item = table(spark, sf, "lineitem")
    return item.select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("author"), F.col("l_quantity").cast("bigint").alias("added"), F.col("l_linenumber").cast("bigint").alias("deleted"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"))


@query("""WITH n AS (SELECT l_partkey AS path, l_suppkey AS author, l_quantity::BIGINT AS added, strftime(l_shipdate, '%Y-%m-%d') AS date FROM lineitem),
h AS (SELECT path, count(*) AS churn, max(date) AS last_modified FROM n GROUP BY path ORDER BY churn DESC, path LIMIT 20),
a AS (SELECT path, author, sum(added)::BIGINT AS added FROM n WHERE path IN (SELECT path FROM h) GROUP BY path, author),
r AS (SELECT *, floor(added::DOUBLE / (sum(added) OVER (PARTITION BY path))::DOUBLE * 1000.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS share, (row_number() OVER (PARTITION BY path ORDER BY added DESC, author))::INTEGER AS rank FROM a)
SELECT path, churn, last_modified, rank, author, added, share FROM r JOIN h USING (path) WHERE rank <= 5""")
def code_ownership(spark, sf):
    """The twenty hottest paths with their five main authors."""
    return history.code_ownership(_numstat(spark, sf))


@query("""SELECT path, added, deleted, coalesce(status, 'modified') AS status FROM (SELECT l_orderkey AS path, sum(l_quantity::BIGINT)::BIGINT AS added, sum(l_linenumber)::BIGINT AS deleted FROM lineitem GROUP BY 1) n LEFT JOIN (SELECT o_orderkey AS path, CASE o_orderstatus WHEN 'F' THEN 'deleted' WHEN 'O' THEN 'added' END AS status FROM orders WHERE o_orderstatus <> 'P') s USING (path)""")
def changed_files(spark, sf):
    """Orders as changed paths: lines added and deleted, and the status."""
    stat = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_quantity").cast("bigint").alias("added"), F.col("l_linenumber").cast("bigint").alias("deleted"))
    o = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    status = o.select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderstatus") == "F", "deleted").when(F.col("o_orderstatus") == "O", "added").alias("status"))
    return history.changed_files(stat, status)



@query("""WITH c AS (SELECT o_orderkey AS sha, o_custkey AS author, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS subject FROM orders ORDER BY date DESC, sha LIMIT 20)
SELECT sha, author, date, subject, coalesce(string_agg(DISTINCT p, ',' ORDER BY p), '') AS files FROM c LEFT JOIN (SELECT l_orderkey AS sha, l_partkey::VARCHAR AS p FROM lineitem) l USING (sha) GROUP BY sha, author, date, subject""")
def commit_log(spark, sf):
    """The twenty newest orders with their parts."""
    commits = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("subject"))
    files = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").cast("string").alias("file"))
    return history.commit_log(commits, files)


@query("""WITH a AS (SELECT p_brand, p_type, count(*) AS n, min(p_retailprice) AS price FROM part WHERE p_size <= 25 GROUP BY 1, 2), b AS (SELECT p_brand, p_type, count(*) AS n, min(p_retailprice) AS price FROM part WHERE p_size > 25 GROUP BY 1, 2)
SELECT * FROM (SELECT p_brand, p_type, a.n AS old_n, b.n AS new_n, a.price AS old_price, b.price AS new_price, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n <> b.n OR a.price <> b.price THEN 'modified' END AS change FROM a FULL JOIN b USING (p_brand, p_type)) s WHERE change IS NOT NULL""")
def schema_diff(spark, sf):
    """Brands and types of small parts against those of large ones."""
    side = lambda c: table(spark, sf, "part").where(c).groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.min("p_retailprice").alias("price"))
    return relations.schema_diff(side("p_size <= 25"), side("p_size > 25"), ["p_brand", "p_type"], ["n", "price"])


@query("""WITH r AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list(DISTINCT json_extract_string(props, '$.k')) AS now FROM events WHERE event_type = 'error' GROUP BY 1, 2), l AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY user_id ORDER BY day), []) AS before FROM r)
SELECT user_id, day, array_to_string(list_sort(list_filter(now, lambda x: NOT list_contains(before, x))), ',') AS new, array_to_string(list_sort(list_filter(before, lambda x: NOT list_contains(now, x))), ',') AS resolved, array_to_string(list_sort(list_filter(now, lambda x: list_contains(before, x))), ',') AS unchanged FROM l""")
def run_delta(spark, sf):
    """Error keys of each user's day against the day before."""
    runs = table(spark, sf, "events").where("event_type = 'error'").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.collect_set(F.get_json_object("props", "$.k")).alias("messages"))
    out = delta.run_delta(runs, ["user_id"], "day")
    return out.select("user_id", "day", *[F.array_join(c, ",").alias(c) for c in ("new", "resolved", "unchanged")])


LEVEL = "CASE WHEN regexp_matches(line, '(?i)ERROR|CRITICAL|FATAL') THEN 'ERROR' WHEN regexp_matches(line, '(?i)WARN') THEN 'WARN' WHEN regexp_matches(line, '(?i)INFO') THEN 'INFO' WHEN regexp_matches(line, '(?i)DEBUG|TRACE') THEN 'DEBUG' ELSE 'OTHER' END"


def _event_lines(spark, sf):
    e = table(spark, sf, "events")
    return e.select("user_id", F.col("event_id").alias("line_no"), "ts", F.concat_ws(" ", "event_type", F.col("value").cast("int").cast("string")).alias("line"))


@query(f"SELECT user_id, count(*) FILTER (WHERE lv = 'ERROR') AS error, count(*) FILTER (WHERE lv = 'WARN') AS warn, count(*) FILTER (WHERE lv = 'INFO') AS info, count(*) FILTER (WHERE lv = 'DEBUG') AS debug, count(*) FILTER (WHERE lv = 'OTHER') AS other FROM (SELECT user_id, {LEVEL} AS lv FROM (SELECT user_id, event_type AS line FROM events) a) b GROUP BY user_id")
def log_level_counts(spark, sf):
    """Events of each user by log level."""
    return lines.level_counts(_event_lines(spark, sf), ["user_id"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS m FROM events) a WHERE m <= 100 AND event_type = 'error') b) c WHERE n <= 10")
def log_tail(spark, sf):
    """The last ten errors among each user's last hundred events."""
    out = lines.log_tail(_event_lines(spark, sf), ["user_id"], 10, "error")
    return out.select("user_id", F.col("line_no").alias("event_id"), F.split("line", " ")[0].alias("event_type"))


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS errors, sum(round(value * 100)::BIGINT)::BIGINT // count(*) AS avg_cents FROM events GROUP BY event_type")
def call_stats(spark, sf):
    """Calls, errors and the mean value of each kind of event."""
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"), F.floor(cents / F.count("*")).cast("bigint").alias("avg_cents"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def recent_calls(spark, sf):
    """The last 500 events."""
    return table(spark, sf, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(500).select("event_id", "user_id", "event_type")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS rows FROM e GROUP BY user_id, event_type, g""")
def islands_sketch(spark, sf):
    """Runs of one kind of event of each user."""
    return lines.islands(table(spark, sf, "events"), ["user_id"], ["event_id"], "event_type").select("user_id", "event_type", "first", "last", "rows")


@query("""SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM events""")
def carry_forward_suite(spark, sf):
    """Each event with the last signup or purchase before it."""
    mark = F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_id"))
    return lines.carry_forward(table(spark, sf, "events"), ["user_id"], ["event_id"], mark, "since").select("event_id", "user_id", "event_type", "since")


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) s WHERE b IS NULL OR b <> event_type""")
def adjacent_distinct(spark, sf):
    """Events that differ in kind from the one before."""
    return lines.adjacent_distinct(table(spark, sf, "events"), ["user_id"], ["event_id"], "event_type").select("event_id", "user_id", "event_type")




@query("""WITH f AS (SELECT event_id AS id, user_id AS package, CASE WHEN s >= 9 THEN 'critical' WHEN s >= 7 THEN 'high' WHEN s >= 4 THEN 'moderate' WHEN s > 0 THEN 'low' ELSE 'unknown' END AS severity FROM (SELECT *, (event_id % 11)::DOUBLE AS s FROM events WHERE event_type = 'error') e)
SELECT package, severity, id FROM f ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, package, id LIMIT 100""")
def audit_rank(spark, sf):
    """Errors as audit findings, by severity."""
    e = table(spark, sf, "events").where("event_type = 'error'")
    found = e.select(F.col("user_id").alias("package"), T.cvss_severity((F.col("event_id") % 11).cast("double")).alias("severity"), F.col("event_id").alias("id"))
    return analyses.audit_rank(found)


MEM = """(SELECT o_custkey AS key, o_orderpriority AS value, o_orderkey AS updated_at, min(o_orderkey) OVER (PARTITION BY o_custkey) AS created_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders)"""


def _memories(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("updated_at"), F.col("o_orderkey").alias("created_at"))
    return store.upsert(o.where("created_at % 2 = 0"), o.where("created_at % 2 = 1"), "key")


@query(f"SELECT key, value, updated_at, created_at FROM {MEM} m WHERE n = 1")
def memory_upsert(spark, sf):
    """Orders as versions of their customer's memory: the newest counts, the oldest dates it."""
    return _memories(spark, sf)


@query(f"SELECT key::VARCHAR AS key, value, updated_at, created_at FROM {MEM} m WHERE n = 1 AND contains(lower(value), 'urgent') ORDER BY updated_at DESC")
def memory_list(spark, sf):
    """Memories that speak of urgent things, the newest first."""
    return store.memory_list(_memories(spark, sf).withColumn("key", F.col("key").cast("string")), search="URGENT")


@query("SELECT o_orderkey AS id, o_orderstatus AS status, substr(o_orderpriority, 1, 1)::INTEGER AS priority, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'O' ORDER BY priority DESC, created_at DESC, id")
def task_list(spark, sf):
    """Open orders as tasks."""
    tasks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").alias("created_at"))
    return store.task_list(tasks, "O")


@query("SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders ORDER BY created_at DESC, id LIMIT 20")
def session_list(spark, sf):
    """The twenty newest sessions."""
    return store.session_list(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at")))


# --- what Spark brings along


@query("""SELECT n_name, r_name, count(*) AS orders, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name""")
def orders_by_nation(spark, sf):
    """Orders and their value by nation (extra)."""
    o, c, n, r = (table(spark, sf, x) for x in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS quantity, max(l_extendedprice) AS most FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf):
    """Line items by flag and status (extra)."""
    item = table(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return item.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"), F.max("l_extendedprice").alias("most"))


@query("""SELECT p_brand, p_size, count(*) AS n, min(p_retailprice) AS least FROM part GROUP BY CUBE (p_brand, p_size)""")
def parts_cube(spark, sf):
    """Parts by brand and size with all sub-totals (extra)."""
    return table(spark, sf, "part").cube("p_brand", "p_size").agg(F.count("*").alias("n"), F.min("p_retailprice").alias("least"))


@query("""SELECT c_custkey, c_mktsegment, c_acctbal, rank() OVER w AS place, ntile(4) OVER w AS quarter FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)""")
def customer_ranks(spark, sf):
    """Customers by balance within their segment (extra)."""
    w = Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", F.rank().over(w).cast("bigint").alias("place"), F.ntile(4).over(w).cast("bigint").alias("quarter"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)""")
def customers_without_orders(spark, sf):
    """Customers without every seventh order (extra)."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderkey % 7 = 0")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("""SELECT e.event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts) AS last_purchase FROM events e WHERE e.event_type = 'error'""")
def as_of_purchase(spark, sf):
    """The last purchase at or before each error, by a window (extra)."""
    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    return e.withColumn("last_purchase", F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(w)).where("event_type = 'error'").select("event_id", "last_purchase")


# --- streams, run to their end


def _stream(spark, sf, name):
    """A table as a stream of its files; a single file is read through its folder."""
    path = f"{sf.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path) if _is_folder(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _is_folder(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("""SELECT date_trunc('hour', ts)::TIMESTAMPTZ AS start, event_type, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1, 2""")
def stream_call_windows(spark, sf):
    """Calls and errors by hour and kind, as a stream run to its end."""
    s = ledger.call_windows(ledger.timed(_stream(spark, sf, "events")))
    return ledger.drained(s.select("start", "event_type", "calls", "errors"), "complete")


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, min(ts)::TIMESTAMPTZ AS start, count(*) AS events FROM s GROUP BY user_id, n""")
def stream_sessions(spark, sf):
    """Sessions of users, as a stream run to its end."""
    s = ledger.sessions(ledger.timed(_stream(spark, sf, "events")))
    return ledger.drained(s.select("user_id", "start", "events"), "complete")


@query("""SELECT conv_id, turn, CASE WHEN before IS NULL THEN 'full' WHEN before = sha256(text) THEN 'unchanged' ELSE 'changed' END AS state FROM (SELECT *, lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) s""")
def stream_ledger(spark, sf):
    """The read ledger over conversations, as a stream run to its end."""
    return ledger.drained(ledger.read_ledger(_stream(spark, sf, "conversations"), "conv_id", "turn", "text", keep_ms=None))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT event_id FROM events) s")
def stream_once(spark, sf):
    """Distinct events, as a stream run to its end."""
    return ledger.drained(ledger.once(ledger.timed(_stream(spark, sf, "events"))).select("event_id")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, event_id, event_type, event_id // 500 AS run, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, last_value(CASE WHEN before IS NULL OR before <> event_type THEN run END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS recorded FROM s)
SELECT user_id::VARCHAR AS path, event_id AS n, CASE WHEN before IS NULL OR before <> event_type THEN 'fresh' WHEN run = recorded THEN 'already_sent' ELSE 'cold' END AS state FROM r""")
def stream_content_ledger(spark, sf):
    """The content ledger over events, its entries in state of their own, as a stream run to its end."""
    s = _stream(spark, sf, "events").withColumns({"id": F.lit("type"), "mtime": F.lit(0), "run": F.floor(F.col("event_id") / 500)})
    return ledger.drained(content.content_ledger(s, "user_id", "id", "event_id", "event_type", "mtime", "run")).select("path", "n", "state")


@query(f"""SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (WHERE user_id % 7 = 0) AS errors, (sum(event_id % 100) // count(*))::BIGINT AS avg_ms, sum(user_id % 50)::BIGINT AS tokens, (sum(user_id % 50) * {stats.SAVED} // 100)::BIGINT AS tokens_saved, count(*) FILTER (WHERE latest <= {board.RECENT}) AS recent
FROM (SELECT *, row_number() OVER (ORDER BY event_id // 10 DESC, event_id DESC) AS latest FROM events) e GROUP BY event_type""")
def stream_dashboard(spark, sf):
    """Calls by tool, and how many of the latest ones are its own, kept by batches that may be replayed, as a stream run to its end."""
    e = _stream(spark, sf, "events")
    calls = e.select(F.floor(F.col("event_id") / 10).alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("tool"), (F.col("user_id") % 7 != 0).alias("success"), (F.col("event_id") % 100).cast("bigint").alias("duration_ms"), (F.col("user_id") % 50).cast("bigint").alias("token_count"))
    path = shared_folder(spark, "board")
    board.record(calls, f"{path}/board", f"{path}/state").awaitTermination()
    by, recent = board.snapshot(spark, f"{path}/board")
    return by.join(recent.groupBy("tool").agg(F.count("*").alias("recent")), "tool", "left").withColumn("recent", F.coalesce("recent", F.lit(0)))
