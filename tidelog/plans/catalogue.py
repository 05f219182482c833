"""Every log operator as a query over the driver's tables, with DuckDB SQL for the ones that SQL can express.

Each pair states the same thing twice and independently: operators on one side, plain SQL on the other.
Whole numbers are BIGINT on both sides.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions import checksum, validate
from tidelog.operators import analytics as A
from tidelog.operators import append, audit, group, scan
from tidelog.operators.fold import membership
from tidelog.schema import LogError
from tidelog.sources.logs import conversation_log, event_log, lineitem_log, table
from tidelog.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOG = """log AS (
  SELECT event_id % 4 AS "partition", row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1 AS "offset",
    event_type || '|' || props AS payload, event_id, ts, user_id, event_type, value FROM events)"""
ENTRIES = [(2, 50), (0, 10), (2, 60), (3, 1_000_000_000), (1, 5)]
ENTRY_ROWS = ", ".join(f"({i}, {p}, {o})" for i, (p, o) in enumerate(ENTRIES))
BUDGET = 900
TIMEOUT = "12 HOURS"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def big(c: str) -> F.Column:
    return F.col(c).cast("bigint").alias(c)


# --- scans -------------------------------------------------------------------------------------------------


@query(f"""WITH {LOG} SELECT "partition", "offset", payload FROM log WHERE "partition" = 1 AND "offset" >= 100""")
def seek_scan(spark, sf_dir):
    return scan.seek(event_log(spark, sf_dir), 1, 100).select(big("partition"), "offset", "payload")


@query(f"""WITH {LOG}, c AS (SELECT *, sum(12 + strlen(payload)) OVER (ORDER BY "offset") AS cum, row_number() OVER (ORDER BY "offset") AS rn
FROM log WHERE "partition" = 1 AND "offset" >= 100)
SELECT "partition", "offset", payload FROM c WHERE rn = 1 OR cum <= 2000""")
def fetch_single_budget(spark, sf_dir):
    return scan.fetch_one(event_log(spark, sf_dir), 1, 100, 2000).select(big("partition"), "offset", "payload")


@query(f"""WITH RECURSIVE {LOG}, e(ord, part, start) AS (VALUES {ENTRY_ROWS}),
r AS (SELECT ord, "partition", "offset", payload, row_number() OVER (ORDER BY ord, "offset") AS i, 12 + strlen(payload) AS cost
      FROM e JOIN log ON part = "partition" AND "offset" >= start AND "offset" < start + 200),
w(i, ord, left_over, served, ended, took) AS (
  SELECT CAST(0 AS BIGINT), -1, CAST({BUDGET} AS BIGINT), false, -1, false
  UNION ALL
  SELECT r.i, r.ord,
    CASE WHEN w.ended <> r.ord AND w.left_over > 0 AND (NOT w.served OR r.cost <= w.left_over) THEN w.left_over - r.cost ELSE w.left_over END,
    w.served OR (w.ended <> r.ord AND w.left_over > 0),
    CASE WHEN w.ended = r.ord OR w.left_over <= 0 OR (w.served AND r.cost > w.left_over) THEN r.ord ELSE w.ended END,
    w.ended <> r.ord AND w.left_over > 0 AND (NOT w.served OR r.cost <= w.left_over)
  FROM w JOIN r ON r.i = w.i + 1)
SELECT CAST(r.ord AS BIGINT) AS ord, "partition", "offset", payload FROM w JOIN r USING (i) WHERE took""")
def fetch_multi_budget(spark, sf_dir):
    return scan.fetch_many(event_log(spark, sf_dir), ENTRIES, BUDGET).select(big("ord"), big("partition"), "offset", "payload")


@query(f"""WITH {LOG}, e(ord, part, start) AS (VALUES {ENTRY_ROWS})
SELECT CAST(ord AS BIGINT) AS ord, CAST(part AS BIGINT) AS "partition", CAST(0 AS BIGINT) AS records FROM e""")
def fetch_empty_shape(spark, sf_dir):
    tail = [(p, 1_000_000_000) for p, _ in ENTRIES]
    return scan.response_counts(scan.fetch_many(event_log(spark, sf_dir), tail, BUDGET), tail)


@query(f"""WITH {LOG} SELECT "partition", "offset", event_id, payload FROM log ORDER BY event_id DESC LIMIT 50""")
def last_50_ring(spark, sf_dir):
    return scan.last_ring(event_log(spark, sf_dir), "event_id").select(big("partition"), "offset", "event_id", "payload")


@query(f"""WITH {LOG} SELECT "partition", "offset", payload FROM log WHERE "offset" = 0""")
def first_per_partition(spark, sf_dir):
    return scan.first_per_partition(event_log(spark, sf_dir))


TOPICS = [("orders", 4), ("a.log", 16), ("events-2", 1), ("0day", 8)]


@query("SELECT name, CAST(partitions AS BIGINT) AS partitions FROM (VALUES ('orders', 4), ('a.log', 16), ('events-2', 1), ('0day', 8)) AS t(name, partitions) ORDER BY name")
def list_topics(spark, sf_dir):
    """Topics made in a new store, as another one that opens its folder lists them."""
    root = tempfile.mkdtemp(prefix="tidelog-")
    try:
        made = Store(spark, f"file:{root}/log")
        for name, partitions in TOPICS:
            made.create_topic(name, partitions)
        return Store(spark, f"file:{root}/log").topics().select("name", big("partitions"))
    finally:
        shutil.rmtree(root)


# --- appends -----------------------------------------------------------------------------------------------


@query(f"""WITH {LOG} SELECT event_id, "partition", "offset", payload FROM log""")
def round_robin_append(spark, sf_dir):
    return event_log(spark, sf_dir).select("event_id", big("partition"), "offset", "payload")


@query("""WITH log AS (SELECT conv_id % 4 AS "partition", row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id, turn) - 1 AS "offset" FROM conversations)
SELECT "partition", count(*) AS records, count(DISTINCT "offset") AS offsets, min("offset") AS first_offset, max("offset") AS last_offset, min("offset") = 0 AND max("offset") = count(*) - 1 AS dense FROM log GROUP BY 1""")
def offset_density(spark, sf_dir):
    return append.offset_density(conversation_log(spark, sf_dir))


@query("""SELECT l_orderkey % 16 AS "partition", count(*) AS records, count(*) AS offsets, CAST(0 AS BIGINT) AS first_offset, count(*) - 1 AS last_offset, true AS dense FROM lineitem GROUP BY 1""")
def lineitem_density(spark, sf_dir):
    return append.offset_density(lineitem_log(spark, sf_dir))


@query(f"""WITH {LOG} SELECT "partition", CAST(sum(8 + strlen(payload)) AS BIGINT) AS frontier_bytes, max("offset") + 1 AS next_offset FROM log GROUP BY 1""")
def byte_frontier(spark, sf_dir):
    return append.byte_frontier(event_log(spark, sf_dir))


@query(f"""WITH {LOG} SELECT "partition", "offset", payload FROM log WHERE "offset" < 300 + 100 * "partition" """)
def frontier_capped_read(spark, sf_dir):
    frontier = spark.sql("SELECT CAST(id AS INT) AS partition, 300 + 100 * id AS next_offset FROM range(4)")
    return append.frontier_capped(event_log(spark, sf_dir), frontier).select(big("partition"), "offset", "payload")


@query(f"""WITH {LOG} SELECT "partition", "offset", CAST(12 + strlen(payload) AS BIGINT) AS fetch_cost, CAST(8 + strlen(payload) AS BIGINT) AS disk_cost FROM log""")
def record_sizes(spark, sf_dir):
    size = F.octet_length("payload").cast("bigint")
    return event_log(spark, sf_dir).select(big("partition"), "offset", S.record_cost(F.col("payload")).alias("fetch_cost"), (size + S.DISK_OVERHEAD).alias("disk_cost"))


# --- groups ------------------------------------------------------------------------------------------------

BEATS = "beats AS (SELECT user_id % 10 AS grp, 'm' || user_id AS member, ts FROM events)"
LIVES = f"""{BEATS}, marked AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL {TIMEOUT} OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM beats WINDOW w AS (PARTITION BY grp, member ORDER BY ts)),
numbered AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY grp, member ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM marked),
lives AS (SELECT grp, member, session, min(ts) AS first_beat, max(ts) AS last_beat, max(ts) + INTERVAL {TIMEOUT} AS dead_at FROM numbered GROUP BY ALL)"""
GENERATIONS = f"""{LIVES}, happened AS (SELECT grp, first_beat AS moment, 1 AS joined, member FROM lives UNION ALL SELECT grp, dead_at, 0, member FROM lives),
gens AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY moment, joined, member) AS generation, moment, CAST(joined AS BIGINT) AS joined, member FROM happened)"""
ASSIGNED = f"""{GENERATIONS}, live AS (SELECT g.grp, g.generation, l.member FROM gens g JOIN lives l ON g.grp = l.grp AND l.first_beat <= g.moment AND l.dead_at > g.moment),
dealt AS (SELECT *, row_number() OVER (PARTITION BY grp, generation ORDER BY member) - 1 AS i, count(*) OVER (PARTITION BY grp, generation) AS n FROM live),
owned AS (SELECT grp, generation, member, p AS "partition" FROM dealt, (SELECT unnest(range(4)) AS p) WHERE p >= i * (4 // n) + least(i, 4 % n) AND p < (i + 1) * (4 // n) + least(i + 1, 4 % n))"""


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("grp"), F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("member"), "ts")


def lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.sessions(beats(spark, sf_dir), TIMEOUT)


@query("""WITH m AS (SELECT DISTINCT user_id % 10 AS grp, 'm' || user_id AS member FROM events),
d AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY member) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM m)
SELECT grp, member, p AS "partition" FROM d, (SELECT unnest(range(16)) AS p) WHERE p >= i * (16 // n) + least(i, 16 % n) AND p < (i + 1) * (16 // n) + least(i + 1, 16 % n)""")
def range_assignment(spark, sf_dir):
    return group.range_assignment(beats(spark, sf_dir).select("grp", "member").distinct(), ["grp"], 16)


@query(f"WITH {LIVES} SELECT grp, member, session, first_beat, last_beat, dead_at FROM lives")
def liveness_sweep(spark, sf_dir):
    return lives(spark, sf_dir)


@query(f"WITH {GENERATIONS} SELECT grp, generation, moment, joined, member FROM gens")
def generation_log(spark, sf_dir):
    return group.generation_log(lives(spark, sf_dir))


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.holdings(lives(spark, sf_dir), 4)


@query(f'WITH {ASSIGNED} SELECT grp, generation, member, "partition" FROM owned')
def assignment_by_generation(spark, sf_dir):
    owned = group.each_generation(holdings(spark, sf_dir).where("size(held) > 0"))
    return owned.select("grp", "generation", "member", F.explode("held").alias("partition"))


@query(f"""WITH {ASSIGNED}, o AS (SELECT grp, member, generation, string_agg("partition", ',' ORDER BY "partition") AS owned FROM owned GROUP BY ALL),
b AS (SELECT *, lag(owned) OVER (PARTITION BY grp, member ORDER BY generation) AS before FROM o)
SELECT grp, member, generation, owned FROM b WHERE owned IS DISTINCT FROM before""")
def ownership_changes(spark, sf_dir):
    return group.ownership_changes(holdings(spark, sf_dir))


@query(f"""WITH {ASSIGNED} SELECT grp, generation, member, count("partition") AS partitions FROM (SELECT l.grp, l.generation, l.member, o."partition" FROM live l LEFT JOIN owned o USING (grp, generation, member)) GROUP BY ALL HAVING count("partition") = 0""")
def idle_members(spark, sf_dir):
    """Members of generations with more members than partitions: live, with nothing assigned."""
    idle = group.each_generation(group.dealt_out(holdings(spark, sf_dir).where("size(held) = 0")))
    return idle.select("grp", "generation", "member", F.lit(0).cast("bigint").alias("partitions"))


FENCES = """SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 13 WHEN user_id % 3 <> event_id % 3 THEN 12 ELSE 0 END AS code FROM events"""


@query(f"SELECT event_id, CAST(code AS BIGINT) AS code FROM ({FENCES})")
def fence_codes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    members = e.select("user_id").distinct().where("user_id % 7 <> 0").withColumn("current", F.col("user_id") % 3).withColumn("known", F.lit(True))
    asked = e.join(members, "user_id", "left").withColumn("generation", F.col("event_id") % 3)
    return asked.select("event_id", group.fence_code(F.col("known"), F.col("current"), F.col("generation")).cast("bigint").alias("code"))


def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).select(F.col("user_id").alias("grp"), big("partition"), (F.col("offset") + 1).alias("next"), F.col("event_id").alias("seq"))


COMMITTED = f'{LOG}, committed AS (SELECT user_id AS grp, "partition", arg_max("offset" + 1, event_id) AS next_offset FROM log GROUP BY ALL)'


@query(f'WITH {COMMITTED} SELECT grp, "partition", next_offset FROM committed')
def commit_merge_latest(spark, sf_dir):
    return group.committed(commit_log(spark, sf_dir))


@query(f"""WITH {COMMITTED}, a AS (SELECT DISTINCT user_id AS grp, p AS "partition" FROM events, (SELECT unnest(range(4)) AS p))
SELECT grp, "partition", coalesce(next_offset, 0) AS next_offset FROM a LEFT JOIN committed USING (grp, "partition")""")
def resume_positions(spark, sf_dir):
    everyone = table(spark, sf_dir, "events").select(F.col("user_id").alias("grp")).distinct().withColumn("partition", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")))
    return group.resume(everyone, group.committed(commit_log(spark, sf_dir)))


@query(f"""WITH {COMMITTED}, f AS (SELECT "partition", max("offset") + 1 AS frontier FROM log GROUP BY 1)
SELECT grp, "partition", next_offset, frontier, frontier - next_offset AS lag FROM committed JOIN f USING ("partition")""")
def consumer_lag(spark, sf_dir):
    return group.lag(append.byte_frontier(event_log(spark, sf_dir)), group.committed(commit_log(spark, sf_dir)))


FOLD_TIMEOUT_MS = 12 * 3600 * 1000
#: Member structs (id, connection, generation joined, last beat) travel from event to event of a group.
FOLD = f"""
WITH RECURSIVE control AS (
  SELECT CAST(user_id % 10 AS VARCHAR) AS grp, event_id AS seq, CAST(epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS BIGINT) AS ms, CAST(user_id AS BIGINT) AS conn,
    CASE event_type WHEN 'signup' THEN 'join' WHEN 'click' THEN 'heartbeat' WHEN 'view' THEN 'heartbeat' WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'leave' END AS op FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY seq) AS nth FROM control),
step AS (
  SELECT grp, CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS VARCHAR) AS member, CAST(0 AS BIGINT) AS generation, CAST(0 AS BIGINT) AS code,
    CAST(NULL AS BOOLEAN) AS rejoin, CAST(0 AS BIGINT) AS swept, CAST(0 AS BIGINT) AS ids, CAST([] AS STRUCT(id VARCHAR, conn BIGINT, gen BIGINT, beat BIGINT)[]) AS members
  FROM (SELECT DISTINCT grp FROM control)
  UNION ALL
  SELECT grp, nth, seq, op, member, generation, code, rejoin, swept, ids,
    list_filter(list_transform(alive, lambda m: CASE WHEN code = 0 AND m.id = member AND op IN ('join', 'heartbeat', 'commit') THEN struct_pack(id := m.id, conn := m.conn, gen := CASE WHEN op = 'join' THEN generation ELSE m.gen END, beat := ms) ELSE m END), lambda m: NOT (op = 'leave' AND code = 0 AND m.id = member))
      || CASE WHEN op = 'join' AND me IS NULL AND code = 0 THEN [struct_pack(id := member, conn := conn, gen := generation, beat := ms)] ELSE [] END
  FROM (
    SELECT grp, nth, seq, op, ms, conn, alive, me, swept, code,
      CASE WHEN me IS NOT NULL THEN me.id WHEN op = 'join' AND code = 0 THEN 'm' || (ids + 1) END AS member,
      gen + CASE WHEN code = 0 AND (op = 'leave' OR op = 'join' AND me IS NULL) THEN 1 ELSE 0 END AS generation,
      CASE WHEN op = 'heartbeat' AND code = 0 THEN me.gen <> gen END AS rejoin,
      ids + CASE WHEN op = 'join' AND me IS NULL AND code = 0 THEN 1 ELSE 0 END AS ids
    FROM (
      SELECT *, CASE WHEN op = 'join' THEN CASE WHEN me IS NULL AND len(alive) >= {S.MAX_MEMBERS} THEN {LogError('CAP_EXCEEDED').code} ELSE 0 END
          WHEN me IS NULL THEN {LogError('UNKNOWN_MEMBER').code} WHEN op = 'commit' AND me.gen <> gen THEN {LogError('STALE_GENERATION').code} ELSE 0 END AS code
      FROM (
        SELECT *, list_filter(alive, lambda m: m.conn = x.conn)[1] AS me FROM (
          SELECT e.grp, e.nth, e.seq, e.op, e.ms, e.conn, list_filter(s.members, lambda m: e.ms - m.beat <= {FOLD_TIMEOUT_MS}) AS alive,
            CAST(len(s.members) - len(list_filter(s.members, lambda m: e.ms - m.beat <= {FOLD_TIMEOUT_MS})) AS BIGINT) AS swept, s.generation + len(s.members) - len(list_filter(s.members, lambda m: e.ms - m.beat <= {FOLD_TIMEOUT_MS})) AS gen, s.ids
          FROM step s JOIN numbered e ON e.grp = s.grp AND e.nth = s.nth + 1) x)))),
owned AS (SELECT *, len(members) AS n, list_position(list_sort(list_transform(members, lambda m: m.id)), member) - 1 AS i FROM step WHERE nth > 0)
SELECT grp, seq, op, coalesce(member, '') AS member, generation, code, coalesce(rejoin, false) AS rejoin, swept,
  CASE WHEN i IS NULL THEN '' ELSE array_to_string(list_transform(range(i * (4 // n) + least(i, 4 % n), (i + 1) * (4 // n) + least(i + 1, 4 % n)), lambda p: CAST(p AS VARCHAR)), ',') END AS owned
FROM owned
"""


@query(FOLD)
def membership_fold(spark, sf_dir):
    """The coordinator's state machine over control events: a row for each event with its outcome. An
    event without a member names none (empty); only beats ask to join again."""
    op = F.create_map(*[F.lit(x) for kv in (("signup", "join"), ("click", "heartbeat"), ("view", "heartbeat"), ("purchase", "commit"), ("error", "leave")) for x in kv])
    e = table(spark, sf_dir, "events")
    control = e.select((F.col("user_id") % 10).cast("string").alias("grp"), F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("conn_id"), op[F.col("event_type")].alias("op"), F.lit(None).cast("bigint").alias("generation"))
    return membership(control, partitions=4, timeout_ms=FOLD_TIMEOUT_MS).fillna({"member": "", "rejoin": False})


# --- analytics ---------------------------------------------------------------------------------------------

REDELIVERED = f'{LOG}, redelivered AS (SELECT *, event_id AS arrival FROM log UNION ALL SELECT *, 1000000000 + event_id FROM log WHERE event_id % 10 = 0)'


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return log.withColumn("arrival", F.col("event_id")).union(log.where("event_id % 10 = 0").withColumn("arrival", F.col("event_id") + 1_000_000_000))


@query(f'WITH {REDELIVERED} SELECT "partition", "offset", event_id, arrival FROM (SELECT *, row_number() OVER (PARTITION BY "partition", "offset" ORDER BY arrival) AS n FROM redelivered) WHERE n = 1')
def dedupe_first(spark, sf_dir):
    return A.dedupe_first(redelivered(spark, sf_dir), ["partition", "offset"], "arrival").select(big("partition"), "offset", "event_id", "arrival")


@query(f'WITH {REDELIVERED} SELECT event_id // 2500 AS iteration, count(*) AS seen, count(*) - count(DISTINCT ("partition", "offset")) AS duplicates FROM redelivered GROUP BY 1')
def duplicate_count(spark, sf_dir):
    rows = redelivered(spark, sf_dir).withColumn("iteration", F.floor(F.col("event_id") / 2500))
    return A.duplicates(rows, ["partition", "offset"], ["iteration"])


@query("""SELECT event_id // 2500 AS iteration, count(*) AS samples, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1""")
def nearest_rank_percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("iteration", F.floor(F.col("event_id") / 2500))
    return e.groupBy("iteration").agg(F.count("*").alias("samples"), *[A.nearest_rank("value", p).alias(f"p{p}") for p in (50, 95, 99)])


RATES = f"""{LOG}, r AS (SELECT event_id // 2500 AS iteration, count(*) AS acked, CAST(sum(strlen(payload)) AS BIGINT) AS bytes, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS secs FROM log GROUP BY 1),
rates AS (SELECT iteration, acked, bytes, CASE WHEN secs > 0 THEN round(acked / secs, 6) ELSE 0 END AS per_sec, CASE WHEN secs > 0 THEN round(bytes / 1e6 / secs, 9) ELSE 0 END AS mb_per_sec FROM r)"""


def bucket_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rates(event_log(spark, sf_dir).withColumn("iteration", F.floor(F.col("event_id") / 2500)), "iteration", "ts", "payload")


@query(f"WITH {RATES} SELECT iteration, acked, bytes, per_sec, mb_per_sec FROM rates")
def rate_per_bucket(spark, sf_dir):
    return bucket_rates(spark, sf_dir)


@query(f"WITH {RATES} SELECT min(per_sec) AS low, max(per_sec) AS high, round(avg(per_sec), 6) AS mean FROM rates")
def spread(spark, sf_dir):
    return A.spread(bucket_rates(spark, sf_dir), "per_sec")


BOUNDS = [(i, f"2024-01-{1 + 7 * i:02d} 00:00:00", f"2024-01-{8 + 7 * i:02d} 00:00:00") for i in range(4)]
BOUND_ROWS = ", ".join(f"(CAST({i} AS BIGINT), CAST('{a}' AS TIMESTAMP), CAST('{b}' AS TIMESTAMP))" for i, a, b in BOUNDS)


@query(f"""SELECT iteration, count(*) AS records, round(min(value), 6) AS least FROM events JOIN (VALUES {BOUND_ROWS}) AS b(iteration, begins, ends) ON ts >= begins AND ts < ends WHERE iteration > 0 GROUP BY 1""")
def iteration_buckets(spark, sf_dir):
    rows = ", ".join(f"({i}L, TIMESTAMP_NTZ '{a}', TIMESTAMP_NTZ '{b}')" for i, a, b in BOUNDS)
    bounds = spark.sql(f"SELECT * FROM VALUES {rows} AS b(iteration, begins, ends)")
    return A.in_iterations(table(spark, sf_dir, "events"), bounds, "ts").groupBy("iteration").agg(F.count("*").alias("records"), F.round(F.min("value"), 6).alias("least"))


@query("""WITH s AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id) * event_id AS counter FROM events)
SELECT user_id, event_id, counter, counter - lag(counter) OVER (PARTITION BY user_id ORDER BY event_id) AS delta FROM s QUALIFY delta IS NOT NULL""")
def counter_delta(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint")
    snaps = table(spark, sf_dir, "events").select("user_id", "event_id", (nth * F.col("event_id")).alias("counter"))
    return A.counter_deltas(snaps, ["user_id"], "event_id", "counter").where("delta IS NOT NULL")


@query(f"""WITH {LOG}, t AS (SELECT event_id // 20 AS tick, count(*) AS new, string_agg(DISTINCT "partition", ',' ORDER BY "partition") AS partitions FROM log GROUP BY 1)
SELECT tick, new, partitions, CAST(sum(new) OVER (ORDER BY tick) AS BIGINT) AS total FROM t""")
def tick_totals(spark, sf_dir):
    return A.tick_totals(event_log(spark, sf_dir).withColumn("tick", F.floor(F.col("event_id") / 20)), "tick", "partition")


@query(f"""WITH {LOG} SELECT "partition", max("offset") + 1 AS next_offset FROM log WHERE event_type <> 'error' GROUP BY 1""")
def consumed_frontier(spark, sf_dir):
    return A.consumed_frontier(event_log(spark, sf_dir).where("event_type <> 'error'"))


@query("""WITH d AS (SELECT event_id // 100 AS tick, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM events GROUP BY 1)
SELECT tick, bytes, bool_or(bytes >= 1185) OVER (ORDER BY tick) AS paused FROM d""")
def sticky_cap(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 100).alias("tick")).agg(F.sum(F.octet_length("props").cast("bigint")).alias("bytes"))
    return A.sticky_cap(d, "tick", "bytes", 1185)


@query("SELECT count(*) AS produced FROM events WHERE event_type <> 'error'")
def produced_counter(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") != "error").alias("produced"))


@query("SELECT event_id, user_id AS producer, event_id AS seq, event_id * 1000 AS sent_ns, CAST(7 AS DOUBLE) AS e2e_ms FROM events")
def binary_header_decode(spark, sf_dir):
    """Headers written as three big-endian numbers come back; receipt is 7 ms after the send time."""
    word = lambda c: F.lpad(F.hex(c), 16, "0")
    e = table(spark, sf_dir, "events").withColumn("payload", F.unhex(F.concat(word("user_id"), word("event_id"), word(F.col("event_id") * 1000), F.lit("00FF"))))
    fields = A.decode_header(F.hex("payload"))
    decoded = e.where(F.octet_length("payload") >= 24).select("event_id", *[c.alias(k) for k, c in fields.items()])
    return decoded.withColumn("e2e_ms", ((F.col("event_id") * 1000 + 7_000_000) - F.col("sent_ns")) / 1e6)


@query(f"""WITH {LOG} SELECT count(*) AS produced, CAST(sum("offset") AS BIGINT) AS offsets, CAST(max(event_id) AS BIGINT) AS latest, CAST(50 AS BIGINT) AS recent FROM log""")
def feed_snapshot(spark, sf_dir):
    log = event_log(spark, sf_dir)
    snap = A.feed_snapshot(log, scan.last_ring(log, "event_id"))
    offsets = F.aggregate("partitions", F.lit(0).cast("double"), lambda s, p: s + p["next_offset"] * (p["next_offset"] - 1) / 2)
    return snap.select("produced", offsets.cast("bigint").alias("offsets"), F.array_max("recent")["event_id"].alias("latest"), F.size("recent").cast("bigint").alias("recent"))


@query("""WITH s AS (SELECT l_orderkey, l_partkey, l_linenumber, l_partkey * CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 1024 WHEN 3 THEN 1048576 ELSE 64 END AS n FROM lineitem)
SELECT l_orderkey, n, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{:.1f} KB', floor(n * 10 / 1024 + 0.5) / 10) WHEN n < 1073741824 THEN format('{:.1f} MB', floor(n * 10 / 1048576 + 0.5) / 10) ELSE format('{:.2f} GB', floor(n * 100 / 1073741824 + 0.5) / 100) END AS size,
CASE WHEN l_orderkey >= 3600 THEN (l_orderkey // 3600) || 'h ' || (l_orderkey // 60 % 60) || 'm' WHEN l_orderkey >= 60 THEN (l_orderkey // 60) || 'm ' || (l_orderkey % 60) || 's' ELSE l_orderkey || 's' END AS up FROM s""")
def display_formats(spark, sf_dir):
    """Sizes from bytes to GB: part keys times a factor by line."""
    times = F.element_at(F.array(*[F.lit(x) for x in (1, 1024, 1 << 20, 64, 64, 64, 64)]), F.col("l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").withColumn("n", F.col("l_partkey") * times.cast("bigint"))
    return rows.select("l_orderkey", "n", A.human_bytes(F.col("n")).alias("size"), A.uptime(F.col("l_orderkey")).alias("up"))


# --- audits ------------------------------------------------------------------------------------------------


@query(f"""WITH {LOG}, j AS (SELECT "partition", "offset", payload FROM log WHERE event_id % 3 = 0), f AS (SELECT "partition", "offset", payload FROM log WHERE event_id % 21 <> 0)
SELECT 'lost' AS problem, "partition", "offset", payload FROM j ANTI JOIN f USING ("partition", "offset", payload)
UNION ALL SELECT 'foreign', "partition", "offset", payload FROM f ANTI JOIN j USING ("partition", "offset", payload) WHERE NOT regexp_matches(payload, '^(click|view|signup)\\|')""")
def containment_audit(spark, sf_dir):
    log = event_log(spark, sf_dir).select(big("partition"), "offset", "payload", "event_id")
    return audit.containment(log.where("event_id % 3 = 0"), log.where("event_id % 21 <> 0"), ["partition", "offset", "payload"], r"\A(click|view|signup)\|")


@query("""WITH p AS (SELECT DISTINCT event_id FROM events), u AS (SELECT event_id FROM events WHERE event_id % 4 < 2 UNION SELECT event_id FROM events WHERE event_id % 4 >= 2 AND event_id % 50 <> 3)
SELECT count(*) AS produced, count(u.event_id) AS covered, count(*) - count(u.event_id) AS missing FROM p LEFT JOIN u USING (event_id)""")
def union_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    return audit.coverage(e, [e.where("event_id % 4 < 2"), e.where("event_id % 4 >= 2 and event_id % 50 <> 3")], ["event_id"])


@query("""WITH c AS (SELECT DISTINCT event_type FROM events), d(event_type) AS (VALUES ('click'), ('view'), ('purchase'), ('refund'))
SELECT event_type, 'left' AS side FROM c WHERE event_type NOT IN (SELECT event_type FROM d) UNION ALL SELECT event_type, 'right' FROM d WHERE event_type NOT IN (SELECT event_type FROM c)""")
def registry_diff(spark, sf_dir):
    documented = spark.createDataFrame([(x,) for x in ("click", "view", "purchase", "refund")], "event_type string")
    return audit.difference(table(spark, sf_dir, "events").select("event_type").distinct(), documented)


@query(f"""WITH {LOG}, j AS (SELECT "partition", max("offset") + 1 AS journaled FROM log GROUP BY 1), r AS (SELECT "partition", max("offset") + 1 AS next_offset FROM log WHERE "partition" <> 2 OR event_id < 900 GROUP BY 1)
SELECT "partition", journaled, next_offset FROM j JOIN r USING ("partition") WHERE next_offset < journaled""")
def commit_recovery_bound(spark, sf_dir):
    log = event_log(spark, sf_dir)
    recovered = A.consumed_frontier(log.where("partition <> 2 or event_id < 900"))
    return audit.commits_behind(A.consumed_frontier(log), recovered).select("partition", "journaled", "next_offset")


@query(f"""WITH {LOG} SELECT CAST(1 AS BIGINT) AS "partition", (SELECT count(*) FROM log WHERE "partition" = 1) AS acknowledged, 'missing' AS problem UNION ALL SELECT 2, (SELECT count(*) FROM log WHERE "partition" = 2), 'repeated'""")
def damage_audit(spark, sf_dir):
    """A log with a lost record in partition 1 and a repeated one in partition 2, held against its manifest."""
    log = event_log(spark, sf_dir)
    broken = log.where("not (partition = 1 and offset = 17)").union(log.where("partition = 2 and offset = 5"))
    return audit.damage(broken, append.byte_frontier(log)).select(big("partition"), "acknowledged", "problem")


# --- validation and scalars --------------------------------------------------------------------------------


@query(rf"""WITH r AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'orders' WHEN 1 THEN 'Bad' WHEN 2 THEN '' WHEN 3 THEN 'a' || chr(10) WHEN 4 THEN 'ghost' ELSE '0day' END AS name, event_id % 20 - 1 AS part, (event_id % 11) * 120000 AS bytes FROM events)
SELECT event_id, CAST(CASE WHEN NOT regexp_full_match(name, '[a-z0-9][a-z0-9._-]{{0,127}}') THEN 4 WHEN bytes > 1048576 THEN 5 WHEN name NOT IN ('orders', '0day') THEN 1 WHEN part < 0 OR part >= CASE name WHEN 'orders' THEN 4 ELSE 8 END THEN 3 ELSE 0 END AS BIGINT) AS code FROM r""")
def request_validation(spark, sf_dir):
    n = F.col("event_id") % 6
    name = F.when(n == 0, "orders").when(n == 1, "Bad").when(n == 2, "").when(n == 3, "a\n").when(n == 4, "ghost").otherwise("0day")
    r = table(spark, sf_dir, "events").select("event_id", name.alias("name"), (F.col("event_id") % 20 - 1).alias("part"), ((F.col("event_id") % 11) * 120000).alias("bytes"))
    topics = spark.createDataFrame(TOPICS, "name string, partitions bigint").withColumn("known", F.lit(True))
    return r.join(F.broadcast(topics), "name", "left").select("event_id", validate.produce_code(F.col("name"), F.col("known"), F.col("part"), F.col("partitions"), F.col("bytes")).cast("bigint").alias("code"))


@query("""WITH r AS (SELECT event_id, event_id % 18 AS entries, (event_id % 5) * 10000 AS wait, (event_id % 7) * 1048576 AS bytes, event_id % 5 AS highest FROM events)
SELECT event_id, CAST(CASE WHEN entries = 0 THEN 7 WHEN entries > 16 THEN 9 WHEN wait > 30000 OR bytes > 4194304 THEN 8 WHEN highest >= 4 THEN 3 ELSE 0 END AS BIGINT) AS code FROM r""")
def fetch_validation(spark, sf_dir):
    i = F.col("event_id")
    code = validate.fetch_code(F.lit("orders"), i % 18, (i % 5) * 10000, (i % 7) * 1048576, F.lit(True), F.lit(4), i % 5)
    return table(spark, sf_dir, "events").select("event_id", code.cast("bigint").alias("code"))


RAW_SETTINGS = ("7", "+64", "1048576", "1048577", "-8", "00", " 9", "3e2", "0x10", "64MB", "9999999999999999999", "", None)
RAW_ROWS = ", ".join("(NULL)" if x is None else f"('{x}')" for x in RAW_SETTINGS)


@query(f"""WITH v(raw) AS (VALUES {RAW_ROWS})
SELECT raw, CAST(CASE WHEN regexp_full_match(raw, '[+-]?[0-9]{{1,18}}') AND TRY_CAST(raw AS BIGINT) BETWEEN 1 AND 1048576 THEN TRY_CAST(raw AS BIGINT) ELSE 200 END AS BIGINT) AS cap FROM v""")
def env_settings(spark, sf_dir):
    raw = spark.createDataFrame([(x,) for x in RAW_SETTINGS], "raw string")
    return raw.select("raw", validate.env_int(F.col("raw"), 200).alias("cap"))


@query("""SELECT conv_id, turn, json_extract_string(j, '$.topic') AS topic, CAST(json_extract_string(j, '$.offsets.0') AS BIGINT) AS next_offset FROM (SELECT conv_id, turn, '{"topic":"c' || conv_id || '","offsets":{"0":' || turn || '}}' AS j FROM conversations)""")
def commit_json(spark, sf_dir):
    """Commit files written as JSON and parsed strictly."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("topic"), F.create_map(F.lit("0"), F.col("turn")).alias("offsets"))).alias("j"))
    parsed = F.from_json("j", "topic STRING, offsets MAP<STRING,BIGINT>", {"mode": "FAILFAST"})
    return rows.select("conv_id", "turn", parsed.alias("p")).select("conv_id", "turn", "p.topic", F.col("p.offsets")["0"].alias("next_offset"))


@query("SELECT event_id, 'msg-' || event_id AS message, event_id % 4 AS target FROM events")
def message_strings(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("msg-"), i.cast("string")).alias("message"), append.round_robin(i, 4).cast("bigint").alias("target"))


CRC_TABLE = f"[{', '.join(map(str, checksum.TABLE.tolist()))}]"  # by the polynomial's rule, in functions/checksum.py


@query(f"""WITH {LOG}, b AS (SELECT "partition", "offset", hex(encode(payload)) AS h FROM log),
n AS (SELECT "partition", "offset", list_transform(range(1, CAST(len(h) AS BIGINT), 2), lambda i: CAST('0x' || h[i:i + 1] AS BIGINT)) AS x FROM b)
SELECT "partition", "offset", xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), x), lambda c, y: xor(CAST({CRC_TABLE}[(xor(c, y) & 255) + 1] AS BIGINT), c >> 8)), CAST(4294967295 AS BIGINT)) AS crc32c FROM n""")
def crc32c(spark, sf_dir):
    return event_log(spark, sf_dir).select(big("partition"), "offset", checksum.crc32c_column(F.col("payload")).alias("crc32c"))
