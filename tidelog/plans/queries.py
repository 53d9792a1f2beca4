"""One named query for each operator, and SQL that computes the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, scalars, wire
from ..functions import envelope as env
from ..operators import decide as machine
from ..operators import eventlog, fold, projection, queues, saga
from ..schemas import NAMESPACE, type_name
from ..sources.tables import commands, table
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# decisions

#: Commands in order with the state before each, one command of every stream a step.
DECIDE_SQL = """
WITH RECURSIVE c AS (
  SELECT 'seat-' || user_id AS stream_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN 'ReleaseSeatHold' ELSE 'HoldSeat' END AS command,
         'hold-' || (CAST(json_extract_string(props, '$.k') AS INT) % 3) AS hold_id, 'booking-' || event_id AS booking_id,
         CASE WHEN event_type = 'purchase' THEN 'payment failed' ELSE '' END AS reason,
         CASE WHEN event_type <> 'purchase' THEN ts + INTERVAL 12 HOUR END AS expires_at,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events WHERE event_type IN ('click', 'signup', 'purchase')),
s AS (
  SELECT stream_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, '' AS command, '' AS hold_id, NULL::VARCHAR AS kind, NULL::VARCHAR AS type, '' AS out_booking, '' AS reason, NULL::TIMESTAMP AS out_expires,
         '' AS held, '' AS booking, NULL::TIMESTAMP AS expires, 0 AS version
  FROM (SELECT DISTINCT stream_id FROM c)
  UNION ALL
  SELECT c.stream_id, c.n, c.event_id, c.command, c.hold_id,
         CASE WHEN (c.command = 'HoldSeat' AND s.held = '') OR (c.command = 'ReleaseSeatHold' AND s.held = c.hold_id) THEN 'event' ELSE 'reply' END,
         CASE WHEN c.command = 'ReleaseSeatHold' THEN 'SeatHoldReleased' WHEN s.held IN ('', c.hold_id) THEN 'SeatHeld' ELSE 'SeatUnavailable' END,
         CASE WHEN c.command = 'HoldSeat' AND s.held = c.hold_id THEN s.booking ELSE c.booking_id END,
         CASE WHEN c.command = 'ReleaseSeatHold' THEN c.reason WHEN s.held IN ('', c.hold_id) THEN '' ELSE 'seat is held' END,
         CASE WHEN c.command = 'HoldSeat' AND s.held = '' THEN c.expires_at WHEN c.command = 'HoldSeat' AND s.held = c.hold_id THEN s.expires END,
         CASE WHEN c.command = 'HoldSeat' AND s.held = '' THEN c.hold_id WHEN c.command = 'ReleaseSeatHold' AND s.held = c.hold_id THEN '' ELSE s.held END,
         CASE WHEN c.command = 'HoldSeat' AND s.held = '' THEN c.booking_id WHEN c.command = 'ReleaseSeatHold' AND s.held = c.hold_id THEN '' ELSE s.booking END,
         CASE WHEN c.command = 'HoldSeat' AND s.held = '' THEN c.expires_at WHEN c.command = 'ReleaseSeatHold' AND s.held = c.hold_id THEN NULL ELSE s.expires END,
         s.version + CASE WHEN (c.command = 'HoldSeat' AND s.held = '') OR (c.command = 'ReleaseSeatHold' AND s.held = c.hold_id) THEN 1 ELSE 0 END
  FROM s JOIN c ON c.stream_id = s.stream_id AND c.n = s.n + 1)
"""


def decided(spark: SparkSession, d: str) -> DataFrame:
    return machine.decide(commands(spark, d))


@query(DECIDE_SQL + "SELECT stream_id, event_id, kind, type, hold_id, out_booking AS booking_id, reason, out_expires AS expires_at, version FROM s WHERE n > 0")
def decide_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Every command's event or reply, with the stream's version after it."""
    return decided(spark, d).drop("at")


@query(DECIDE_SQL + f"SELECT 'inventory.events' AS topic, '{NAMESPACE}.' || type AS type, kind, reason, count(*) AS n FROM s WHERE n > 0 GROUP BY ALL")
def decide_messages(spark: SparkSession, d: str) -> DataFrame:
    """What an outcome publishes, events and replies alike, by type."""
    out = decided(spark, d).select(F.lit("inventory.events").alias("topic"), F.concat(F.lit(f"{NAMESPACE}."), "type").alias("type"), "kind", "reason")
    return out.groupBy("topic", "type", "kind", "reason").agg(F.count("*").alias("n"))


AVAILABILITY_SQL = DECIDE_SQL + """, last AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY n DESC) AS back FROM s)
SELECT stream_id AS seat_id, CASE WHEN held = '' THEN 'free' ELSE 'held' END AS status, held AS hold_id, booking AS booking_id, expires AS expires_at, version FROM last WHERE back = 1 AND version > 0"""


@query(AVAILABILITY_SQL)
def seat_availability(spark: SparkSession, d: str) -> DataFrame:
    """Commands decided, events appended and folded: which seats are held, by whom, at what version."""
    appended = decided(spark, d).filter("kind = 'event'")
    held = F.col("last.type") == "SeatHeld"
    text = lambda f: F.when(held, F.col(f"last.{f}")).otherwise("").alias(f)
    found = appended.groupBy("stream_id").agg(F.max_by(F.struct("type", "hold_id", "booking_id", "expires_at"), "version").alias("last"), F.count("*").cast("int").alias("version"))
    return found.select(F.col("stream_id").alias("seat_id"), F.when(held, "held").otherwise("free").alias("status"), text("hold_id"), text("booking_id"), F.when(held, F.col("last.expires_at")).alias("expires_at"), "version")


TTL_SQL = """
WITH RECURSIVE c AS (SELECT user_id, event_id, ts FROM events WHERE event_type IN ('click', 'signup')),
won AS (
  SELECT user_id, min(ts) AS ts FROM c GROUP BY user_id
  UNION ALL
  SELECT w.user_id, (SELECT min(c.ts) FROM c WHERE c.user_id = w.user_id AND c.ts >= w.ts + INTERVAL 12 HOUR) FROM won w WHERE w.ts IS NOT NULL),
held AS (SELECT c.* FROM c JOIN won ON won.user_id = c.user_id AND won.ts = c.ts)
SELECT 'seat-' || user_id AS stream_id, 'hold-' || event_id AS hold_id, ts AS at, 'SeatHeld' AS type FROM held
UNION ALL SELECT 'seat-' || user_id, 'hold-' || event_id, ts + INTERVAL 12 HOUR, 'SeatHoldExpired' FROM held
"""


@query(TTL_SQL)
def hold_ttl_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Holds that end by deadline: each command its own hold, no releases; timers still pending at the end fire."""
    only = commands(spark, d).filter("command = 'HoldSeat'").withColumn("hold_id", F.concat(F.lit("hold-"), F.col("event_id").cast("string")))
    return machine.decide(only, timed=True, until_end=True).filter("kind = 'event'").select("stream_id", "hold_id", "at", "type")


#: The same with deadlines: before each command the first due timer that names the live hold ends it. out: what a step gives, at most one expiry and one outcome.
TIMED_SQL = """
WITH RECURSIVE c0 AS (
  SELECT 'seat-' || user_id AS stream_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN 'ReleaseSeatHold' ELSE 'HoldSeat' END AS command,
         'hold-' || (CAST(json_extract_string(props, '$.k') AS INT) % 3) AS hold_id, 'booking-' || event_id AS booking_id,
         CASE WHEN event_type = 'purchase' THEN 'payment failed' ELSE '' END AS reason,
         CASE WHEN event_type <> 'purchase' THEN ts + INTERVAL 12 HOUR END AS expires_at
  FROM events WHERE event_type IN ('click', 'signup', 'purchase')),
c1 AS (SELECT * FROM c0 UNION ALL {more}),
c AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts, event_id NULLS LAST) AS n FROM c1),
s AS (
  SELECT DISTINCT stream_id, 0::BIGINT AS n, '' AS held, '' AS booking, NULL::TIMESTAMP AS expires, 0 AS version, []::STRUCT(f TIMESTAMP, t VARCHAR)[] AS timers,
         []::STRUCT(event_id BIGINT, "at" TIMESTAMP, kind VARCHAR, type VARCHAR, hold_id VARCHAR, booking_id VARCHAR, reason VARCHAR, expires_at TIMESTAMP, version INT)[] AS out
  FROM c
  UNION ALL
  SELECT stream_id, n,
         CASE WHEN command = 'HoldSeat' AND held1 = '' THEN hold_id WHEN command = 'ReleaseSeatHold' AND held1 = hold_id THEN '' ELSE held1 END,
         CASE WHEN command = 'HoldSeat' AND held1 = '' THEN booking_id WHEN command = 'ReleaseSeatHold' AND held1 = hold_id THEN '' ELSE booking1 END,
         CASE WHEN command = 'HoldSeat' AND held1 = '' THEN expires_at WHEN command = 'ReleaseSeatHold' AND held1 = hold_id THEN NULL ELSE expires1 END,
         (version1 + changes)::INT,
         CASE WHEN command = 'HoldSeat' AND held1 = '' THEN list_append(later, {{'f': expires_at, 't': hold_id}}) ELSE later END,
         list_concat(
           CASE WHEN ended IS NOT NULL THEN [{{'event_id': NULL::BIGINT, 'at': ended, 'kind': 'event', 'type': 'SeatHoldExpired', 'hold_id': held, 'booking_id': booking, 'reason': '', 'expires_at': NULL::TIMESTAMP, 'version': version1::INT}}] ELSE [] END,
           CASE WHEN command = 'End' THEN [] ELSE [{{'event_id': event_id, 'at': ts, 'kind': CASE WHEN changes = 1 THEN 'event' ELSE 'reply' END,
             'type': CASE WHEN command = 'ReleaseSeatHold' THEN 'SeatHoldReleased' WHEN held1 IN ('', hold_id) THEN 'SeatHeld' ELSE 'SeatUnavailable' END, 'hold_id': hold_id,
             'booking_id': CASE WHEN command = 'HoldSeat' AND held1 = hold_id THEN booking1 ELSE booking_id END,
             'reason': CASE WHEN command = 'ReleaseSeatHold' THEN reason WHEN held1 IN ('', hold_id) THEN '' ELSE 'seat is held' END,
             'expires_at': CASE WHEN command = 'HoldSeat' AND held1 = '' THEN expires_at WHEN command = 'HoldSeat' AND held1 = hold_id THEN expires1 END, 'version': (version1 + changes)::INT}}] END)
  FROM (
    SELECT *, CASE WHEN (command = 'HoldSeat' AND held1 = '') OR (command = 'ReleaseSeatHold' AND held1 = hold_id) THEN 1 ELSE 0 END AS changes
    FROM (
      SELECT *, CASE WHEN ended IS NULL THEN held ELSE '' END AS held1, CASE WHEN ended IS NULL THEN booking ELSE '' END AS booking1, CASE WHEN ended IS NULL THEN expires END AS expires1,
             version + CASE WHEN ended IS NULL THEN 0 ELSE 1 END AS version1
      FROM (
        SELECT c.stream_id, c.n, c.event_id, c.ts, c.command, c.hold_id, c.booking_id, c.reason, c.expires_at, s.held, s.booking, s.expires, s.version,
               list_min(list_transform(list_filter(s.timers, lambda t: t.f <= c.ts AND t.t = s.held AND s.held <> ''), lambda t: t.f)) AS ended, list_filter(s.timers, lambda t: t.f > c.ts) AS later
        FROM s JOIN c ON c.stream_id = s.stream_id AND c.n = s.n + 1))))
"""
_NO_MORE = "SELECT * FROM c0 WHERE false"
#: Time goes on after the last command to the watermark: the latest command less an hour.
_WATERMARK = "SELECT DISTINCT stream_id, NULL, (SELECT max(ts) FROM c0) - INTERVAL 1 HOUR, 'End', '', '', '', NULL::TIMESTAMP FROM c0"
_TIMED_ROWS = "SELECT stream_id, o.event_id, o.\"at\", o.kind, o.type, o.hold_id, o.booking_id, o.reason, o.expires_at, o.version FROM (SELECT stream_id, unnest(out) AS o FROM s)"


@query(TIMED_SQL.format(more=_NO_MORE) + _TIMED_ROWS)
def decide_timed(spark: SparkSession, d: str) -> DataFrame:
    """All commands with deadlines, holds that share ids included."""
    return machine.decide(commands(spark, d), timed=True)


@query(f"WITH {fx.RECORDS_SQL} SELECT \"offset\", CASE WHEN parse_error IS NOT NULL THEN 'permanent' WHEN kind NOT IN ('HoldSeat', 'ReleaseSeatHold') THEN 'permanent' END AS error_class, CASE WHEN parse_error IS NOT NULL THEN parse_error WHEN kind NOT IN ('HoldSeat', 'ReleaseSeatHold') THEN 'unknown command' END AS error FROM parsed")
def command_routing_errors(spark: SparkSession, d: str) -> DataFrame:
    """Why a record is no command that can be applied, and whether trying again could help."""
    parsed = fx.records(spark, d).withColumn("e", env.parse(F.col("headers")))
    known = F.col("e.type").isin(type_name("HoldSeat"), type_name("ReleaseSeatHold"))
    error = F.coalesce(F.col("e.error"), F.when(~known, "unknown command"))
    return parsed.select("offset", queues.error_class(error).alias("error_class"), error.alias("error"))


# the log

LOG = f"WITH {fx.LOG_SQL}"
FOLD = f"{LOG}, {fx.FOLD_SQL}"


@query(LOG + "SELECT global_seq, version, type, data, meta, recorded_at FROM log WHERE stream_id = 'seat-7' ORDER BY version")
def stream_load(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.load(fx.log(spark, d, user=7), "seat-7").drop("stream_id")


@query("SELECT DISTINCT 'seat-' || user_id AS stream_id FROM events ORDER BY 1")
def streams_distinct(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.streams(table(spark, d, "events").select(F.concat(F.lit("seat-"), F.col("user_id").cast("string")).alias("stream_id")))


@query("SELECT 'order-' || l_orderkey AS stream_id, l_partkey AS part, (l_orderkey % 4 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate))::INT AS version FROM lineitem")
def append_versions(spark: SparkSession, d: str) -> DataFrame:
    """Events numbered on from their stream's expected version, in order."""
    items = table(spark, d, "lineitem").withColumns({"stream_id": F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")), "expected_version": F.col("l_orderkey") % 4})
    numbered = eventlog.number_rows(items, ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"])
    return numbered.select("stream_id", F.col("l_partkey").alias("part"), "version")


_ARRIVAL = "l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity"


@query(f"SELECT stream_id, conflict, count(*) AS n FROM (SELECT l_orderkey AS stream_id, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ARRIVAL}) > 1 OR l_linenumber <= l_orderkey % 3 AS conflict FROM lineitem) GROUP BY ALL")
def append_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Appends that meet a version which the log or an earlier writer has: all but the first lose."""
    tried = table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "stream_id", "l_linenumber": "version"})
    heads = tried.select("stream_id").distinct().withColumn("head", (F.col("stream_id") % 3).cast("int"))
    taken = heads.filter("head > 0").select("stream_id", F.explode(F.sequence(F.lit(1), F.col("head"))).alias("version"))
    marked = eventlog.detect_conflicts(tried, [F.col(c) for c in _ARRIVAL.split(", ")], taken)
    return marked.groupBy("stream_id", "conflict").agg(F.count("*").alias("n"))


_STATE_COLUMNS = "stream_id, status, hold_id, booking_id, expires_at, version"


def _ntz(df: DataFrame) -> DataFrame:
    return df.withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))


@query(FOLD + f"SELECT {_STATE_COLUMNS}, NULL::VARCHAR AS error FROM state")
def seat_fold_latest(spark: SparkSession, d: str) -> DataFrame:
    return _ntz(fold.fold(fx.log(spark, d)))


@query(FOLD + f"SELECT {_STATE_COLUMNS}, NULL::VARCHAR AS error FROM state")
def seat_fold_ordered(spark: SparkSession, d: str) -> DataFrame:
    return _ntz(fold.fold_ordered(fx.log(spark, d)))


@query(FOLD + "SELECT stream_id, json_extract_string(last_meta, '$.correlation_id') AS correlation_id, json_extract_string(last_meta, '$.causation_id') AS causation_id, version FROM state")
def last_meta(spark: SparkSession, d: str) -> DataFrame:
    """The flow that set each stream's state."""
    found = fold.fold(fx.log(spark, d), with_meta=True)
    return found.select("stream_id", F.get_json_object("last_meta", "$.correlation_id").alias("correlation_id"), F.get_json_object("last_meta", "$.causation_id").alias("causation_id"), "version")


@query(LOG + "SELECT stream_id, count(*) FILTER (name = 'SeatHeld') AS held, sum((name <> 'SeatHeld')::INT)::BIGINT AS unknown FROM log GROUP BY 1")
def fold_unknown_events(spark: SparkSession, d: str) -> DataFrame:
    """How many events of each stream a reader that knows only SeatHeld could fold."""
    known = F.col("type") == type_name("SeatHeld")
    return fx.log(spark, d).groupBy("stream_id").agg(F.count_if(known).alias("held"), F.sum((~known).cast("long")).alias("unknown"))


# the view

VIEW_COLUMNS = "stream_id AS seat_id, status, hold_id, booking_id, expires_at, version"


@query(FOLD + f"SELECT {VIEW_COLUMNS} FROM state")
def availability_rebuild(spark: SparkSession, d: str) -> DataFrame:
    return _ntz(projection.rebuild(fx.log(spark, d)))


def _old_view(view: DataFrame) -> DataFrame:
    """A view in which some seats are missing, some behind and some ahead."""
    n = F.regexp_extract("seat_id", r"(\d+)$", 1).cast("int") % 4
    return view.filter(n > 0).withColumn("version", (F.col("version") + F.when(n == 1, -1).when(n == 2, 9).otherwise(0)).cast("int")).withColumn("hold_id", F.lit("old"))


@query(FOLD + f""", n AS (SELECT {VIEW_COLUMNS}, CAST(substr(stream_id, 6) AS INT) % 4 AS m FROM state)
SELECT seat_id, status, CASE WHEN m IN (2, 3) THEN 'old' ELSE hold_id END AS hold_id, booking_id, expires_at, (version + CASE WHEN m = 2 THEN 9 ELSE 0 END)::INT AS version FROM n""")
def availability_guarded_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Only a higher version replaces a row."""
    view = _ntz(projection.rebuild(fx.log(spark, d)))
    return projection.guarded_upsert(_old_view(view), view)


@query(FOLD + f", n AS (SELECT {VIEW_COLUMNS}, CAST(substr(stream_id, 6) AS INT) % 4 AS m FROM state) SELECT seat_id, status, CASE WHEN m IN (1, 2, 3) AND NOT (m = 1 AND CAST(substr(seat_id, 6) AS INT) % 2 = 1) THEN 'old' ELSE hold_id END AS hold_id, booking_id, expires_at, (version + CASE WHEN m = 2 THEN 9 ELSE 0 END)::INT AS version FROM n WHERE m > 0 OR CAST(substr(seat_id, 6) AS INT) % 2 = 1")
def view_notifications(spark: SparkSession, d: str) -> DataFrame:
    """The view after notifications about odd seats: those streams are folded anew, no payload is read."""
    log = fx.log(spark, d)
    told = table(spark, d, "events").filter("user_id % 2 = 1").select(F.concat(F.lit("seat-"), F.col("user_id").cast("string")).alias("subject"))
    return _ntz(projection.project(_old_view(projection.rebuild(log)), log, told))


@query(FOLD + f"SELECT {VIEW_COLUMNS} FROM state WHERE stream_id = 'seat-11'")
def availability_point(spark: SparkSession, d: str) -> DataFrame:
    return _ntz(projection.availability(projection.rebuild(fx.log(spark, d, user=11)), "seat-11"))


@query(FOLD + "SELECT stream_id AS seat_id FROM state WHERE status = 'held' AND stream_id LIKE 'seat_1%' ORDER BY 1")
def held_seats_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The prefix is a pattern: its underscore stands for any character."""
    return projection.held_seats(projection.rebuild(fx.log(spark, d)), "seat_1")


# inbox

INBOX = f"WITH {fx.DELIVERIES_SQL}, {fx.INBOX_SQL} "


@query(INBOX + ", n AS (SELECT *, row_number() OVER (PARTITION BY consumer, source, event_id ORDER BY \"offset\", attempt) AS r FROM deliveries) SELECT consumer, source, event_id, \"offset\", attempt, ts FROM n WHERE r = 1")
def inbox_first_delivery(spark: SparkSession, d: str) -> DataFrame:
    return queues.first_deliveries(fx.deliveries(spark, d), ["offset", "attempt"])


@query(INBOX + "SELECT * FROM deliveries ANTI JOIN inbox USING (consumer, source, event_id)")
def inbox_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return queues.unseen(fx.deliveries(spark, d), fx.inbox(spark, d))


@query(INBOX + "SELECT consumer, source, event_id, handled_at FROM inbox UNION ALL SELECT DISTINCT consumer, source, event_id, TIMESTAMP '2024-01-16 00:00:00' FROM deliveries ANTI JOIN inbox USING (consumer, source, event_id)")
def inbox_mark_consumed(spark: SparkSession, d: str) -> DataFrame:
    return queues.mark_consumed(fx.inbox(spark, d), fx.deliveries(spark, d), fx.as_of())


@query(INBOX + "SELECT consumer, count(*) AS delivered, count(DISTINCT (source, event_id)) AS applied FROM deliveries GROUP BY 1")
def inbox_per_consumer(spark: SparkSession, d: str) -> DataFrame:
    """Consumers are independent: the same message is new to each."""
    both = fx.deliveries(spark, d).groupBy(*queues.INBOX_KEY).agg(F.count("*").alias("n"))
    return both.groupBy("consumer").agg(F.sum("n").alias("delivered"), F.count("*").alias("applied"))


@query(f"WITH {fx.INBOX_SQL} SELECT * FROM inbox WHERE NOT handled_at < TIMESTAMP '2024-01-16' - INTERVAL 7 DAY")
def inbox_prune(spark: SparkSession, d: str) -> DataFrame:
    return queues.prune_inbox(fx.inbox(spark, d), fx.as_of())


# outbox

OUTBOX = f"WITH {fx.OUTBOX_SQL} "


@query(OUTBOX + "SELECT id, topic, key FROM outbox WHERE published_at IS NULL ORDER BY id LIMIT 100")
def outbox_pending_topk(spark: SparkSession, d: str) -> DataFrame:
    return queues.claim_pending(fx.outbox(spark, d)).select("id", "topic", "key")


@query(OUTBOX + "SELECT id, CASE WHEN id IN (SELECT id FROM outbox WHERE published_at IS NULL ORDER BY id LIMIT 100) THEN TIMESTAMP '2024-01-16' ELSE published_at END AS published_at FROM outbox")
def outbox_drain(spark: SparkSession, d: str) -> DataFrame:
    """The outbox after one batch was claimed and published."""
    box = fx.outbox(spark, d)
    return queues.mark_published(box, queues.claim_pending(box), fx.as_of()).select("id", "published_at")


@query(OUTBOX + ", p AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM outbox WHERE published_at IS NULL) SELECT o.id, CASE WHEN p.n <= 250 THEN TIMESTAMP '2024-01-16' ELSE published_at END AS published_at FROM outbox o LEFT JOIN p USING (id)")
def outbox_drain_all(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 50 until the publisher fails, on its sixth: what it did not take stays pending."""
    calls = []

    def publish(batch: DataFrame) -> None:
        calls.append(1)
        if len(calls) > 5:
            raise ConnectionError("the broker is down")

    return queues.drain(fx.outbox(spark, d), publish, fx.as_of(), limit=50)[0].select("id", "published_at")


@query(OUTBOX + "SELECT id, published_at FROM outbox WHERE published_at IS NULL OR NOT published_at < TIMESTAMP '2024-01-16' - INTERVAL 7 DAY")
def outbox_prune(spark: SparkSession, d: str) -> DataFrame:
    return queues.prune_outbox(fx.outbox(spark, d), fx.as_of()).select("id", "published_at")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """A batch of messages for each user, in order of event."""
    one = F.struct("ts", "event_id", F.lit("inventory.events").alias("topic"), F.concat(F.lit("seat-"), F.col("user_id").cast("string")).alias("key"), F.when(F.col("k") % 50 != 0, F.encode("props", "UTF-8")).alias("payload"))
    return fx.events(spark, d).groupBy(F.col("user_id").alias("batch")).agg(F.array_sort(F.collect_list(one)).alias("messages"))


_ENQUEUE = """WITH m AS (SELECT user_id AS batch, event_id, CAST(json_extract_string(props, '$.k') AS INT) % 50 = 0 AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events),
step AS (SELECT max(n) AS step FROM m), refused AS (SELECT batch, min(place) AS place FROM m WHERE bad GROUP BY 1) """


@query(_ENQUEUE + "SELECT batch, (1000 + batch * step + place)::BIGINT AS id, event_id FROM m, step WHERE batch NOT IN (SELECT batch FROM refused)")
def enqueue_ids(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a batch keep their caller's order, and no two have the same id."""
    rows, _ = queues.enqueue(_messages(spark, d), "batch", first_id=1000)
    return rows.select("batch", "id", F.col("message.event_id").alias("event_id"))


@query(_ENQUEUE + "SELECT batch, 'message ' || place || ': no payload' AS error FROM refused")
def enqueue_refusals(spark: SparkSession, d: str) -> DataFrame:
    """One bad message refuses its whole batch."""
    return queues.enqueue(_messages(spark, d), "batch")[1]


@query("SELECT coalesce(error, 'valid') AS verdict, count(*) AS n FROM (SELECT CASE WHEN k % 7 = 0 THEN 'no topic' WHEN k % 7 = 1 THEN 'no key' WHEN k % 7 = 2 THEN 'no payload' END AS error FROM (SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)) GROUP BY 1")
def message_validation(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("k") % 7
    error = env.validate_message(F.when(m == 0, "").otherwise("t"), F.when(m <= 1, "").otherwise("key"), F.when(m <= 2, F.lit("").cast("binary")).otherwise(F.encode("props", "UTF-8")))
    return fx.events(spark, d).select(F.coalesce(error, F.lit("valid")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT coalesce(error, 'valid') AS verdict, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'no type' WHEN CAST(json_extract_string(props, '$.k') AS INT) % 5 = 0 THEN 'no data' END AS error FROM events) GROUP BY 1")
def event_validation(spark: SparkSession, d: str) -> DataFrame:
    error = env.validate_event(F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")), F.when(F.col("k") % 5 == 0, F.lit("")).otherwise(F.col("props")))
    return fx.events(spark, d).select(F.coalesce(error, F.lit("valid")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT coalesce(error, 'valid') AS verdict, count(*) AS n FROM (SELECT CASE WHEN k % 5 = 0 THEN 'no consumer' WHEN k % 5 = 1 THEN 'no source' WHEN k % 5 = 2 THEN 'no event_id' END AS error FROM (SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)) GROUP BY 1")
def inbox_key_validation(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("k") % 5
    error = env.validate_inbox_key(F.when(m == 0, "").otherwise("c"), F.when(m <= 1, "").otherwise("s"), F.when(m <= 2, "").otherwise("e"))
    return fx.events(spark, d).select(F.coalesce(error, F.lit("valid")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


# timers

TIMERS = f"WITH {fx.TIMERS_SQL}"


@query(TIMERS + "SELECT id, fire_at, subject, token FROM timers WHERE fired_at IS NULL AND fire_at <= TIMESTAMP '2024-01-16' ORDER BY fire_at, id LIMIT 100")
def timers_due(spark: SparkSession, d: str) -> DataFrame:
    return queues.due(fx.timers(spark, d), fx.as_of()).drop("fired_at")


@query(TIMERS + "SELECT min(fire_at) AS fire_at FROM timers WHERE fired_at IS NULL")
def timers_next_due(spark: SparkSession, d: str) -> DataFrame:
    return queues.next_due(fx.timers(spark, d))


@query(TIMERS + "SELECT id, fired_at FROM timers WHERE fired_at IS NULL OR NOT fired_at <= TIMESTAMP '2024-01-16' - INTERVAL 7 DAY")
def timers_prune_inclusive(spark: SparkSession, d: str) -> DataFrame:
    return queues.prune_timers(fx.timers(spark, d), fx.as_of()).select("id", "fired_at")


@query(TIMERS + "SELECT id, CASE WHEN fired_at IS NULL AND id % 2 = 0 THEN TIMESTAMP '2024-01-16' ELSE fired_at END AS fired_at, fired_at IS NULL AND id % 2 = 0 AS claimed FROM timers")
def timers_mark_fired(spark: SparkSession, d: str) -> DataFrame:
    """A claim changes pending timers only, so of two claims one wins."""
    timers = fx.timers(spark, d)
    return queues.mark_fired(timers, timers.filter("id % 2 = 0"), fx.as_of()).select("id", "fired_at", "claimed")


@query(DECIDE_SQL + "SELECT stream_id AS subject, hold_id AS token, out_expires AS fire_at FROM s WHERE n > 0 AND kind = 'event' AND type = 'SeatHeld'")
def timers_schedule(spark: SparkSession, d: str) -> DataFrame:
    """The timer that each new hold asks for."""
    return decided(spark, d).filter("kind = 'event' and type = 'SeatHeld'").select(F.col("stream_id").alias("subject"), F.col("hold_id").alias("token"), F.col("expires_at").alias("fire_at"))


@query(FOLD + f", {fx.TIMERS_SQL} SELECT t.id, t.subject, t.token, s.version FROM timers t JOIN state s ON s.stream_id = t.subject AND s.status = 'held' AND s.hold_id = t.token WHERE t.fired_at IS NULL")
def timer_token_fence(spark: SparkSession, d: str) -> DataFrame:
    """Timers that would end the live hold; the rest are stale."""
    pending = fx.timers(spark, d).filter("fired_at is null")
    return queues.fence(pending, fold.fold(fx.log(spark, d))).select("id", "subject", "token", "version")


# messages

RECORDS = f"WITH {fx.RECORDS_SQL}"


@query(RECORDS + "SELECT \"offset\", front || rest AS headers FROM parsed")
def envelope_headers(spark: SparkSession, d: str) -> DataFrame:
    return fx.records(spark, d).select("offset", env.header_text(F.col("headers")).alias("headers"))


@query(RECORDS + "SELECT \"offset\", id, source, type, subject, correlation_id, parse_error AS error FROM parsed")
def envelope_parse_errors(spark: SparkSession, d: str) -> DataFrame:
    found = fx.records(spark, d).select("offset", env.parse(F.col("headers")).alias("e"))
    return found.select("offset", "e.id", "e.source", "e.type", "e.subject", "e.correlation_id", "e.error")


@query(RECORDS + "SELECT \"offset\", front || rest AS headers FROM parsed")
def record_headers_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Headers as a transport carries them, and back."""
    listed = fx.records(spark, d).select("offset", env.to_record_headers(F.col("headers")).alias("h"))
    return listed.select("offset", env.header_text(env.from_record_headers(F.col("h"))).alias("headers"))


@query(f"SELECT DISTINCT CASE WHEN event_type IN ('click', 'signup', 'view') THEN 'inventory.events-{NAMESPACE}.SeatHeld' WHEN event_type = 'purchase' THEN 'inventory.events-{NAMESPACE}.SeatHoldReleased' ELSE 'inventory.events-{NAMESPACE}.SeatHoldExpired' END AS subject, 'inventory.events.dlq' AS dead_letters FROM events")
def subject_names(spark: SparkSession, d: str) -> DataFrame:
    topic = F.lit("inventory.events")
    kind = F.concat(F.lit(f"{NAMESPACE}."), fx.short_type(F.col("event_type")))
    return fx.events(spark, d).select(scalars.subject_name(topic, kind).alias("subject"), scalars.dlq_topic(topic).alias("dead_letters")).distinct()


@query(DECIDE_SQL + f"SELECT event_id, 'inventory.events' AS topic, stream_id AS key, 'ce_causationid=ce-' || event_id || ';ce_correlationid=saga-' || stream_id || ';ce_id=out-' || event_id || ';ce_source=/inventory;ce_specversion=1.0;ce_subject=' || stream_id || ';ce_type={NAMESPACE}.' || type || ';content-type=application/protobuf' AS headers FROM s WHERE n > 0")
def reply_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Outgoing messages: the flow of the command that caused them, caused by its id, keyed by the stream."""
    number = F.col("event_id").cast("string")
    headers = env.render(id=F.concat(F.lit("out-"), number), source=F.lit("/inventory"), type=F.concat(F.lit(f"{NAMESPACE}."), "type"), subject=F.col("stream_id"), correlation_id=F.concat(F.lit("saga-"), "stream_id"), causation_id=F.concat(F.lit("ce-"), number))
    return decided(spark, d).select("event_id", F.lit("inventory.events").alias("topic"), F.col("stream_id").alias("key"), env.header_text(headers).alias("headers"))


@query(LOG + "SELECT global_seq, name AS message, hold_id, booking_id, stream_id AS seat_id, CASE WHEN name = 'SeatHoldReleased' THEN 'payment failed' ELSE '' END AS reason, CASE WHEN name = 'SeatHeld' THEN expires_at END AS expires_at, NULL::VARCHAR AS error FROM log")
def event_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    found = fx.log(spark, d).select("global_seq", codec.decode(F.col("type"), F.col("data")).alias("m")).select("global_seq", "m.*")
    return _ntz(found)


@query("SELECT event_id, CASE WHEN k % 4 = 0 THEN 'unknown type' WHEN k % 4 = 1 THEN 'malformed' WHEN k % 4 = 2 THEN 'unknown field colour' END AS error FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)")
def unknown_field_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Payloads that a strict reader refuses, each for its own reason."""
    m = F.col("k") % 4
    kind = F.when(m == 0, "inventory.v1.SeatPainted").otherwise(type_name("SeatHoldExpired"))
    data = F.when(m == 1, '{"hold_id":').when(m == 2, '{"hold_id":"h","colour":"red"}').otherwise('{"hold_id":"h"}')
    return fx.events(spark, d).select("event_id", codec.decode(kind, data)["error"].alias("error"))


# delivery

SETTLED = RECORDS + """, judged AS (
  SELECT *, coalesce(parse_error, CASE WHEN failures > 0 THEN 'database is down' END) AS error FROM parsed),
settled AS (
  SELECT *, CASE WHEN error IS NULL OR parse_error IS NOT NULL THEN 1 ELSE least(failures + 1, 5) END AS attempts,
         CASE WHEN parse_error IS NOT NULL OR failures >= 5 THEN 'dlq' ELSE 'done' END AS outcome FROM judged)
"""


def _settled(spark: SparkSession, d: str) -> DataFrame:
    parsed = fx.records(spark, d).withColumn("error", F.coalesce(env.parse(F.col("headers"))["error"], F.when(F.col("failures") > 0, "database is down")))
    attempts, outcome = queues.settle(F.col("error"), F.col("failures"))
    return parsed.withColumn("attempts", attempts).withColumn("outcome", outcome)


@query(SETTLED + "SELECT \"offset\", attempts, outcome FROM settled")
def retry_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Attempts and outcome of each record: permanent errors at once, transient ones after five tries, go to dead letters."""
    return _settled(spark, d).select("offset", "attempts", "outcome")


@query(SETTLED + "SELECT 'inventory.commands.dlq' AS topic, key, front || rest || ';dlq_error=' || error || ';dlq_offset=' || \"offset\" || ';dlq_partition=' || partition || ';dlq_topic=inventory.commands' AS headers FROM settled WHERE outcome = 'dlq'")
def dlq_routing(spark: SparkSession, d: str) -> DataFrame:
    dead = queues.dead_letter(_settled(spark, d).filter("outcome = 'dlq'"), F.col("error"))
    return dead.select("topic", "key", env.header_text(F.col("headers")).alias("headers"))


@query(RECORDS + ", stop AS (SELECT partition, min(\"offset\") AS o FROM parsed WHERE \"offset\" % 997 = 13 GROUP BY 1) SELECT p.partition, p.\"offset\" FROM parsed p LEFT JOIN stop USING (partition) WHERE o IS NULL OR p.\"offset\" < o")
def partition_stall_gate(spark: SparkSession, d: str) -> DataFrame:
    """Records before the first that cannot be settled, partition by partition."""
    return queues.stall_gate(fx.records(spark, d), F.col("offset") % 997 == 13).select("partition", "offset")


@query(RECORDS + "SELECT topic, partition, greatest(max(\"offset\") + 1, CASE WHEN partition = 0 THEN 1000000000 ELSE 0 END) AS next_offset FROM parsed GROUP BY topic, partition")
def committed_offsets(spark: SparkSession, d: str) -> DataFrame:
    """One past the highest settled offset; what was committed before is never taken back."""
    earlier = spark.createDataFrame([("inventory.commands", 0, 1_000_000_000), ("inventory.commands", 1, 0)], "topic string, partition int, next_offset long")
    return queues.committed_offsets(fx.records(spark, d), earlier)


@query("SELECT event_id, 100 * 2 ^ (k % 4) AS wait_from, 200 * 2 ^ (k % 4) AS wait_below, CASE WHEN k % 3 = 0 THEN 1000 ELSE least(greatest(k * 7, 5), 1000) END AS sleep FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)")
def waits(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of retry waits, and how long a scheduler sleeps."""
    low, high = scalars.backoff_ms(100, F.col("k") % 4 + 1)
    sleep = scalars.sleep_ms(F.when(F.col("k") % 3 != 0, F.col("k") * 7))
    return fx.events(spark, d).select("event_id", low.cast("double").alias("wait_from"), high.cast("double").alias("wait_below"), sleep.alias("sleep"))


@query("SELECT event_id, lower('00' || lpad(to_hex(event_id), 8, '0') || '00' || hex(encode(props))) AS framed, event_id::INT AS schema_id, props AS body, NULL::VARCHAR AS error FROM events")
def confluent_framing(spark: SparkSession, d: str) -> DataFrame:
    """Registry framing of a payload, and back."""
    framed = fx.events(spark, d).withColumn("f", scalars.frame(F.col("event_id"), F.encode("props", "UTF-8")))
    back = framed.withColumn("u", scalars.unframe(F.col("f")))
    return back.select("event_id", F.lower(F.hex("f")).alias("framed"), "u.schema_id", F.decode("u.body", "UTF-8").alias("body"), "u.error")


# specified but not built there: reports over the same tables


@query(INBOX + ", d AS (SELECT consumer, count(*)::DOUBLE AS n, count(DISTINCT (source, event_id)) AS k FROM deliveries GROUP BY 1) SELECT consumer, 1 - k / n AS duplicate_rate FROM d")
def metric_duplicate_rate(spark: SparkSession, d: str) -> DataFrame:
    keys = fx.deliveries(spark, d).groupBy(*queues.INBOX_KEY).agg(F.count("*").alias("n"))
    return keys.groupBy("consumer").agg((1 - F.count("*") / F.sum("n")).alias("duplicate_rate"))


@query(OUTBOX + "SELECT topic, count(*) AS pending, min(id) AS oldest FROM outbox WHERE published_at IS NULL GROUP BY 1")
def metric_outbox_lag(spark: SparkSession, d: str) -> DataFrame:
    return fx.outbox(spark, d).filter("published_at is null").groupBy("topic").agg(F.count("*").alias("pending"), F.min("id").alias("oldest"))


@query(SETTLED + "SELECT partition, count(*) AS depth FROM settled WHERE outcome = 'dlq' GROUP BY 1")
def metric_dlq_depth(spark: SparkSession, d: str) -> DataFrame:
    return _settled(spark, d).filter("outcome = 'dlq'").groupBy("partition").agg(F.count("*").alias("depth"))


@query(LOG + "SELECT json_extract_string(meta, '$.correlation_id') AS flow, count(*) AS events, min(recorded_at) AS first_at, max(recorded_at) AS last_at FROM log GROUP BY 1")
def correlation_flows(spark: SparkSession, d: str) -> DataFrame:
    flow = F.get_json_object("meta", "$.correlation_id")
    return fx.log(spark, d).groupBy(flow.alias("flow")).agg(F.count("*").alias("events"), F.min("recorded_at").alias("first_at"), F.max("recorded_at").alias("last_at"))


_STREAM_SQL = TIMED_SQL.format(more=_WATERMARK).replace("row_number() OVER (PARTITION BY stream_id ORDER BY ts, event_id NULLS LAST)", "row_number() OVER (PARTITION BY stream_id ORDER BY (command = 'End'), ts, 'ce-' || event_id)")


@query(_STREAM_SQL + "SELECT stream_id, o.kind, o.type, o.hold_id, o.booking_id, o.reason, o.expires_at, o.version, coalesce('ce-' || o.event_id, '') AS causation_id, 'saga-' || stream_id AS correlation_id FROM (SELECT stream_id, unnest(out) AS o FROM s)")
def seat_service_stream(spark: SparkSession, d: str) -> DataFrame:
    """All commands through the stateful streaming service: every row it gives, those included that only the watermark ends."""
    from .streamed import service_rows

    return _ntz(service_rows(spark, d).drop("ce_id"))


# races and refusals


@query("""
WITH c AS (SELECT 'seat-' || user_id AS stream_id, user_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN 'ReleaseSeatHold' ELSE 'HoldSeat' END AS command, 'hold-' || (CAST(json_extract_string(props, '$.k') AS INT) % 3) AS hold_id
  FROM events WHERE event_type IN ('click', 'signup', 'purchase')),
m AS (SELECT *, user_id % 3 = 0 AS held, user_id % 3 = 2 AS broken, CASE WHEN user_id % 3 = 0 THEN command = 'ReleaseSeatHold' AND hold_id = 'hold-0' ELSE command = 'HoldSeat' END AS wants FROM c),
w AS (SELECT *, wants AND row_number() OVER (PARTITION BY stream_id, wants ORDER BY ts, event_id) = 1 AS won, first_value(hold_id) OVER (PARTITION BY stream_id, wants ORDER BY ts, event_id) AS winner FROM m)
SELECT stream_id, event_id, CASE WHEN broken THEN NULL WHEN won THEN 'event' ELSE 'reply' END AS kind,
       CASE WHEN broken THEN NULL WHEN command = 'ReleaseSeatHold' THEN 'SeatHoldReleased' WHEN held THEN CASE WHEN hold_id = 'hold-0' THEN 'SeatHeld' ELSE 'SeatUnavailable' END
            WHEN won OR hold_id = winner THEN 'SeatHeld' ELSE 'SeatUnavailable' END AS type,
       CASE WHEN broken THEN NULL WHEN held THEN CASE WHEN wants THEN 2 ELSE 1 END ELSE CASE WHEN wants THEN 1 ELSE 0 END END::INT AS version,
       CASE WHEN wants AND NOT won AND NOT broken THEN 2 ELSE 1 END::INT AS attempts, CASE WHEN broken THEN 'v1: malformed' END AS error
FROM w""")
def conflict_retry(spark: SparkSession, d: str) -> DataFrame:
    """Commands that all load their seat at once: one wins each round, the others decide again. Some seats are held before, some cannot be folded."""
    user = F.regexp_extract("stream_id", r"(\d+)$", 1).cast("int")
    before = commands(spark, d).select("stream_id").distinct().filter(user % 3 != 1)
    data = F.when(user % 3 == 0, F.lit('{"hold_id":"hold-0","booking_id":"before"}')).otherwise(F.lit('{"hold_id":'))
    log = before.select("stream_id", F.lit(1).alias("version"), F.lit(type_name("SeatHeld")).alias("type"), data.alias("data"))
    return machine.race(commands(spark, d), fold.fold(log)).select("stream_id", "event_id", "kind", "type", "version", "attempts", "error")


#: Batches of up to three events of a seat, some of which expect versions that are taken or come from a refused batch, some with an event without data.
_BATCHES = """
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, CAST(json_extract_string(props, '$.k') AS INT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT user_id, min(event_id) AS batch_id, count(*) AS size, arg_min(k, n) % 5 AS expected, bool_or(k % 23 = 0) AS bad, (n - 1) // 3 AS part FROM e GROUP BY user_id, part),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY batch_id) AS turn FROM b WHERE NOT bad),
s AS (
  SELECT DISTINCT user_id, 0::BIGINT AS turn, CASE WHEN user_id % 2 = 0 THEN [1, 2] ELSE [1, 4] END::BIGINT[] AS taken, 0::BIGINT AS batch_id, true AS won, 0::BIGINT AS expected, 0::BIGINT AS size FROM o
  UNION ALL
  SELECT user_id, turn, CASE WHEN free THEN list_concat(taken, asked) ELSE taken END, batch_id, free, expected, size
  FROM (SELECT o.user_id, o.turn, s.taken, o.batch_id, o.expected, o.size, range(o.expected + 1, o.expected + o.size + 1) AS asked, NOT list_has_any(s.taken, range(o.expected + 1, o.expected + o.size + 1)) AS free
        FROM s JOIN o ON o.user_id = s.user_id AND o.turn = s.turn + 1))
"""


def _append_batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    parts = fx.events(spark, d).withColumn("n", place).withColumn("part", F.floor(F.col("n") / 3))
    event = F.struct("n", F.lit(type_name("SeatHeld")).alias("type"), F.when(F.col("k") % 23 != 0, F.lit("{}")).otherwise("").alias("data"))
    grouped = parts.groupBy("user_id", "part").agg(F.min("event_id").alias("batch_id"), F.min_by("k", "n").alias("k"), F.array_sort(F.collect_list(event)).alias("events"))
    stream = F.concat(F.lit("seat-"), F.col("user_id").cast("string")).alias("stream_id")
    batches = grouped.select("batch_id", stream, (F.col("k") % 5).alias("expected_version"), "events")
    there = table(spark, d, "events").select("user_id").distinct().select(stream, F.explode(F.when(F.col("user_id") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(4)))).alias("version"))
    return eventlog.append(there, batches)


@query(_BATCHES + "SELECT batch_id, 'seat-' || user_id AS stream_id, (expected + i)::INT AS version FROM (SELECT *, unnest(range(1, size + 1)) AS i FROM s WHERE turn > 0 AND won)")
def append_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches decided one after the other: a refused one takes no version, and a version that no event has is free."""
    return _append_batches(spark, d)[0].select("batch_id", "stream_id", "version")


@query(_BATCHES + ", first_bad AS (SELECT user_id, (n - 1) // 3 AS part, min((n - 1) % 3) AS at FROM e WHERE k % 23 = 0 GROUP BY ALL) SELECT batch_id, 'version conflict' AS error FROM s WHERE turn > 0 AND NOT won UNION ALL SELECT b.batch_id, 'event ' || f.at || ': no data' FROM b JOIN first_bad f USING (user_id, part)")
def append_refusals(spark: SparkSession, d: str) -> DataFrame:
    return _append_batches(spark, d)[1]


@query(DECIDE_SQL + f"""SELECT event_id AS batch_id, stream_id, version, '{NAMESPACE}.' || type AS type,
  CASE type WHEN 'SeatHeld' THEN '{{"hold_id":"' || hold_id || '","booking_id":"' || out_booking || '","seat_id":"' || stream_id || '","expires_at":"' || strftime(date_trunc('second', out_expires), '%Y-%m-%dT%H:%M:%SZ') || '"}}'
            ELSE '{{"hold_id":"' || hold_id || '","booking_id":"' || out_booking || '","seat_id":"' || stream_id || '","reason":"' || reason || '"}}' END AS data, '{{"correlation_id":"saga-' || stream_id || '","causation_id":"ce-' || event_id || '"}}' AS meta
  FROM s WHERE n > 0 AND kind = 'event'""")
def append_seat(spark: SparkSession, d: str) -> DataFrame:
    """What commands decide, encoded and appended at the version they were decided at."""
    rows = decided(spark, d).filter("kind = 'event'")
    message = F.struct(F.col("type").alias("message"), "hold_id", "booking_id", F.col("stream_id").alias("seat_id"), "reason", F.date_trunc("second", F.col("expires_at").cast("timestamp")).alias("expires_at"))
    batches = rows.select(F.col("event_id").alias("batch_id"), "stream_id", (F.col("version") - 1).alias("expected_version"), F.array(message).alias("events"), F.concat(F.lit("saga-"), "stream_id").alias("correlation_id"), F.concat(F.lit("ce-"), F.col("event_id").cast("string")).alias("causation_id"))
    nothing = rows.limit(0).select("stream_id", "version")
    accepted, _ = eventlog.append_seat(nothing, batches)
    return accepted.select("batch_id", "stream_id", "version", "event.type", "event.data", "event.meta")


_BROKEN = LOG + """, broken AS (SELECT *, CASE WHEN k % 41 = 0 THEN 'malformed' WHEN k % 41 = 1 THEN 'unknown field colour' WHEN k % 41 = 2 THEN 'unknown type' END AS error,
  k % 41 = 3 AS command FROM (SELECT l.*, named.k FROM log l JOIN named ON named.event_id = l.global_seq)),
why AS (SELECT stream_id, coalesce('v' || min(version) FILTER (error IS NOT NULL) || ': ' || arg_min(error, version) FILTER (error IS NOT NULL), CASE WHEN bool_or(command) THEN 'unknown event' END) AS error FROM broken GROUP BY 1) """


def _broken_log(spark: SparkSession, d: str) -> DataFrame:
    """The log with payloads that cannot be read, types that nobody knows, and commands."""
    k = fx.events(spark, d).select(F.col("event_id").alias("global_seq"), (F.col("k") % 41).alias("m"))
    data = F.when(F.col("m") == 0, '{"hold_id":').when(F.col("m") == 1, '{"hold_id":"h","colour":"red"}').when(F.col("m") == 3, "{}").otherwise(F.col("data"))
    kind = F.when(F.col("m") == 2, f"{NAMESPACE}.SeatPainted").when(F.col("m") == 3, type_name("HoldSeat")).otherwise(F.col("type"))
    return fx.log(spark, d).join(k, "global_seq").withColumns({"data": data, "type": kind}).drop("m")


@query(_BROKEN + "SELECT stream_id, CASE WHEN w.error IS NULL THEN CASE WHEN l.name = 'SeatHeld' THEN 'held' ELSE 'free' END END AS status, w.error FROM why w JOIN (SELECT stream_id, arg_max(name, version) AS name FROM log GROUP BY 1) l USING (stream_id)")
def fold_decode_errors(spark: SparkSession, d: str) -> DataFrame:
    """One event that cannot be decoded anywhere fails its stream, by the first of them."""
    return fold.fold(_broken_log(spark, d)).select("stream_id", "status", "error")


@query(_BROKEN + "SELECT stream_id, error FROM why WHERE error IS NOT NULL")
def rebuild_errors(spark: SparkSession, d: str) -> DataFrame:
    """Streams that keep a view from being rebuilt."""
    return projection.split(fold.fold_ordered(_broken_log(spark, d)))[1]


@query(_BROKEN + "SELECT DISTINCT 'seat-' || user_id AS subject, w.error, 'transient' AS error_class FROM events JOIN why w ON w.stream_id = 'seat-' || user_id WHERE user_id % 2 = 1 AND w.error IS NOT NULL UNION ALL SELECT '', 'missing attribute ce_subject', 'permanent'")
def notification_errors(spark: SparkSession, d: str) -> DataFrame:
    """Notifications that change nothing: one without a subject, and those of streams that cannot be folded."""
    told = table(spark, d, "events").filter("user_id % 2 = 1").select(F.concat(F.lit("seat-"), F.col("user_id").cast("string")).alias("subject"))
    return projection.notification_errors(_broken_log(spark, d), told.unionByName(spark.createDataFrame([("",)], "subject string")))


@query(f"WITH {fx.LOG_SQL}, {fx.FOLD_SQL}, {fx.TIMERS_SQL}, due AS (SELECT * FROM timers WHERE fired_at IS NULL AND fire_at <= TIMESTAMP '2024-01-16' ORDER BY fire_at, id LIMIT 100) SELECT d.id, d.subject, d.token, CASE WHEN s.hold_id = d.token AND s.status = 'held' THEN 'expired' ELSE 'stale' END AS outcome, CASE WHEN s.hold_id = d.token AND s.status = 'held' THEN s.version + 1 END AS version FROM due d LEFT JOIN state s ON s.stream_id = d.subject")
def timers_tick(spark: SparkSession, d: str) -> DataFrame:
    """One pass over the due timers, a hundred at most: which holds they end."""
    return queues.fire(fx.timers(spark, d), fold.fold(fx.log(spark, d)), fx.as_of())


@query(LOG + "SELECT global_seq, hold_id, booking_id, stream_id AS seat_id, expires_at, NULL::VARCHAR AS error FROM log WHERE name = 'SeatHeld'")
def wire_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Messages in their framed binary form and back."""
    m = codec.decode(F.col("type"), F.col("data"))
    rows = fx.log(spark, d).select("global_seq", m.alias("m")).filter("m.message = 'SeatHeld'")
    body = wire.encode("SeatHeld", hold_id=F.col("m.hold_id"), booking_id=F.col("m.booking_id"), seat_id=F.col("m.seat_id"), expires_at=F.col("m.expires_at"))
    framed = rows.select("global_seq", body.alias("body")).withColumn("u", scalars.unframe(scalars.frame(F.lit(3), F.col("body"))))
    return _ntz(framed.select("global_seq", wire.decode("SeatHeld", F.col("u.body")).alias("d")).select("global_seq", "d.*"))


# sagas, specified but not built there

#: Rows of the compensation matrix: what comes in, and the commands that follow.
SAGAS = (
    ("SeatUnavailable", "HoldSeat"),
    ("SeatHeld RoomUnavailable", "HoldSeat ReserveRoom ReleaseSeatHold"),
    ("SeatHeld RoomReserved PaymentDeclined", "HoldSeat ReserveRoom CapturePayment CancelRoom ReleaseSeatHold"),
    ("SeatHeld RoomReserved SeatHoldExpired PaymentDeclined", "HoldSeat ReserveRoom CapturePayment CancelRoom"),
    ("SeatHeld RoomReserved PaymentCaptured SeatHoldExpired", "HoldSeat ReserveRoom CapturePayment ConfirmSeatHold ConfirmRoom RefundPayment CancelRoom"),
    ("SeatHeld RoomReserved PaymentCaptured SeatConfirmFailed", "HoldSeat ReserveRoom CapturePayment ConfirmSeatHold ConfirmRoom RefundPayment CancelRoom"),
    ("SeatHeld StepTimedOut:ReserveRoom/1 StepTimedOut:ReserveRoom/1 RoomReserved StepTimedOut:ReserveRoom/2", "HoldSeat ReserveRoom ReserveRoom CapturePayment"),
    ("StepTimedOut:HoldSeat/1 StepTimedOut:HoldSeat/2 StepTimedOut:HoldSeat/3 StepTimedOut:HoldSeat/4 StepTimedOut:HoldSeat/5 SeatHeld SeatHeld", "HoldSeat HoldSeat HoldSeat HoldSeat HoldSeat ReleaseSeatHold"),
    ("SeatHeld SeatHeld RoomReserved PaymentCaptured SeatConfirmed RoomConfirmed RoomConfirmed", "HoldSeat ReserveRoom CapturePayment ConfirmSeatHold ConfirmRoom"),
)


@query("SELECT 'saga-' || o_orderkey AS saga_id, CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(SAGAS)) + " END AS commands FROM orders")
def saga_commands(spark: SparkSession, d: str) -> DataFrame:
    """Each row of the compensation matrix, repeated events, late replies and timeouts among them, over many sagas."""
    text = F.element_at(F.array(*[F.lit(f"BookingRequested {e}") for e, _ in SAGAS]), (F.col("o_orderkey") % 9 + 1).cast("int"))
    told = table(spark, d, "orders").select(F.concat(F.lit("saga-"), F.col("o_orderkey").cast("string")).alias("saga_id"), F.posexplode(F.split(text, " ")).alias("event_id", "event"))
    parts = F.split("event", ":")
    events = told.select("saga_id", F.col("event_id").cast("long").alias("event_id"), F.lit(0).alias("ts"), parts[0].alias("type"), F.try_element_at(parts, F.lit(2)).alias("token"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "command"))), lambda x: x["command"])
    return saga.run(events).groupBy("saga_id").agg(F.array_join(ordered, " ").alias("commands"))


@query("SELECT 'saga-' || o_orderkey AS saga_id, 'ReserveRoom' AS step, o_orderkey % 3 AS attempt, o_orderdate::TIMESTAMP AS at, o_orderdate::TIMESTAMP + INTERVAL 30 SECOND AS fire_at FROM orders WHERE o_orderdate::TIMESTAMP + INTERVAL 30 SECOND <= TIMESTAMP '1997-01-01' AND (o_orderkey % 4 = 0 OR o_orderkey % 60 > 30)")
def saga_timeouts(spark: SparkSession, d: str) -> DataFrame:
    """Steps asked for that nobody has answered in thirty seconds; some answers come late, some never."""
    orders = table(spark, d, "orders").select(F.concat(F.lit("saga-"), F.col("o_orderkey").cast("string")).alias("saga_id"), F.lit("ReserveRoom").alias("step"), (F.col("o_orderkey") % 3).alias("attempt"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"), "o_orderkey")
    replies = orders.filter("o_orderkey % 4 <> 0").select("saga_id", "step", (F.col("at") + F.make_dt_interval(secs=(F.col("o_orderkey") % 60).cast("decimal(18,6)"))).alias("at"))
    return saga.overdue(orders.drop("o_orderkey"), replies, F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"))


_PAYMENTS = """
WITH r AS (SELECT DISTINCT 'pay-' || (l_orderkey // 2) AS payment_id, 'step-' || (l_linenumber % 2) AS step FROM lineitem),
k AS (SELECT payment_id || '/' || step AS idempotency_key, payment_id, CAST(substr(payment_id, 5) AS BIGINT) AS p FROM r),
a AS (SELECT idempotency_key, payment_id, p, CASE p % 4 WHEN 1 THEN 'pending' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'failed' END AS status, CASE WHEN p % 4 = 2 THEN 'ref-' || p END AS provider_ref FROM k)
"""


def _payments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Requests to charge, many of them repeated, and the attempts of before."""
    requests = table(spark, d, "lineitem").select(F.concat(F.lit("pay-"), F.floor(F.col("l_orderkey") / 2).cast("string")).alias("payment_id"), F.concat(F.lit("step-"), (F.col("l_linenumber") % 2).cast("string")).alias("step"))
    p = F.substring("payment_id", 5, 20).cast("long")
    status = F.when(p % 4 == 1, "pending").when(p % 4 == 2, "succeeded").otherwise("failed")
    known = requests.distinct().filter(p % 4 != 0)
    return requests, known.select(saga.attempt_key(F.col("payment_id"), F.col("step")).alias("idempotency_key"), "payment_id", status.alias("status"), F.when(p % 4 == 2, F.concat(F.lit("ref-"), p.cast("string"))).alias("provider_ref"))


@query(_PAYMENTS + "SELECT idempotency_key, payment_id, CASE WHEN status IS NULL THEN 'charge' WHEN status = 'pending' THEN 'ask' ELSE 'reply' END AS action, status, provider_ref FROM a")
def payment_charges(spark: SparkSession, d: str) -> DataFrame:
    """A charge is made once for its key, however often it is asked for; one that may have been made is asked about."""
    return saga.charge(*_payments(spark, d))[1]


@query(_PAYMENTS + "SELECT idempotency_key, payment_id, CASE WHEN status = 'pending' AND p % 3 = 0 THEN 'succeeded' WHEN status = 'pending' AND p % 3 = 1 THEN 'failed' ELSE status END AS status, CASE WHEN status = 'pending' AND p % 3 = 0 THEN 'new-' || p ELSE provider_ref END AS provider_ref FROM a WHERE status IS NOT NULL")
def payment_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Pending attempts after the provider was asked about their keys."""
    _, attempts = _payments(spark, d)
    p = F.substring("payment_id", 5, 20).cast("long")
    provider = attempts.filter(p % 3 != 2).select("idempotency_key", (p % 3 == 0).alias("charged"), F.when(p % 3 == 0, F.concat(F.lit("new-"), p.cast("string"))).alias("ref"))
    return saga.reconcile(attempts, provider)


@query("""
WITH e AS (SELECT l_orderkey AS booking_id, l_linenumber AS version, ['SeatHeld', 'RoomReserved', 'PaymentCaptured', 'SeatHoldExpired', 'RoomCancelled', 'BookingConfirmed', 'BookingRejected'][((l_partkey + l_linenumber) % 7 + 1)::INT] AS type FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1)
SELECT booking_id, coalesce(CASE arg_max(type, version) FILTER (type IN ('BookingConfirmed', 'BookingRejected')) WHEN 'BookingConfirmed' THEN 'confirmed' WHEN 'BookingRejected' THEN 'rejected' END, 'pending') AS status,
  coalesce(CASE arg_max(type, version) FILTER (type IN ('SeatHeld', 'SeatHoldExpired')) WHEN 'SeatHeld' THEN 'held' WHEN 'SeatHoldExpired' THEN 'released' END, 'none') AS seat,
  coalesce(CASE arg_max(type, version) FILTER (type IN ('RoomReserved', 'RoomCancelled')) WHEN 'RoomReserved' THEN 'held' WHEN 'RoomCancelled' THEN 'released' END, 'none') AS room,
  CASE WHEN bool_or(type = 'PaymentCaptured') THEN 'held' ELSE 'none' END AS payment, max(version) AS version FROM e GROUP BY 1""")
def bookings_view(spark: SparkSession, d: str) -> DataFrame:
    """What became of each booking, from its events."""
    kinds = ["SeatHeld", "RoomReserved", "PaymentCaptured", "SeatHoldExpired", "RoomCancelled", "BookingConfirmed", "BookingRejected"]
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("booking_id"), F.col("l_linenumber").alias("version")).agg(F.min(F.struct("l_partkey", "l_suppkey", "l_extendedprice")).alias("m"))
    kind = F.element_at(F.array(*map(F.lit, kinds)), ((F.col("m.l_partkey") + F.col("version")) % 7 + 1).cast("int"))
    return saga.bookings_view(items.select("booking_id", "version", kind.alias("type")))


@query(_BATCHES + ", judged AS (SELECT batch_id, user_id, NOT won AS lost FROM s WHERE turn > 0) SELECT 'seat-' || (user_id % 10) AS prefix, count(*) AS batches, sum(lost::INT)::BIGINT AS conflicts, avg(lost::INT) AS conflict_rate FROM judged GROUP BY 1")
def metric_conflict_rate(spark: SparkSession, d: str) -> DataFrame:
    """How many appends met a version conflict, by a group of streams."""
    accepted, refused = _append_batches(spark, d)
    users = table(spark, d, "events").groupBy(F.col("event_id").alias("batch_id")).agg(F.min("user_id").alias("user_id"))
    tried = accepted.select("batch_id").distinct().withColumn("lost", F.lit(0)).unionByName(refused.filter(F.col("error") == eventlog.CONFLICT).select("batch_id").withColumn("lost", F.lit(1)))
    named = tried.join(users, "batch_id").withColumn("prefix", F.concat(F.lit("seat-"), (F.col("user_id") % 10).cast("string")))
    return named.groupBy("prefix").agg(F.count("*").alias("batches"), F.sum(F.col("lost").cast("long")).alias("conflicts"), F.avg("lost").alias("conflict_rate"))


@query(LOG + ", d AS (SELECT stream_id, arg_max(name, version) AS outcome, epoch_us(max(recorded_at)) - epoch_us(min(recorded_at)) AS us FROM log GROUP BY 1) SELECT outcome, count(*) AS sagas, avg(us / 1e6) AS mean_s, max(us / 1e6) AS longest_s FROM d GROUP BY 1")
def metric_saga_duration(spark: SparkSession, d: str) -> DataFrame:
    """How long flows took, by how they ended."""
    log = fx.log(spark, d)
    each = log.groupBy("stream_id").agg(F.max_by("type", "version").alias("type"), (F.max(F.unix_micros(F.col("recorded_at").cast("timestamp"))) - F.min(F.unix_micros(F.col("recorded_at").cast("timestamp")))).alias("us"))
    return each.groupBy(F.substring_index("type", ".", -1).alias("outcome")).agg(F.count("*").alias("sagas"), F.avg(F.col("us") / 1e6).alias("mean_s"), F.max(F.col("us") / 1e6).alias("longest_s"))


@query(LOG + ", m AS (SELECT global_seq AS event_id, stream_id, version, max(CASE WHEN version % 6 = 1 THEN version END) OVER (PARTITION BY stream_id ORDER BY version) AS first FROM log) SELECT event_id, first_value(event_id) OVER (PARTITION BY stream_id, first ORDER BY version) AS root, (version - first)::INT AS depth FROM m")
def causation_roots(spark: SparkSession, d: str) -> DataFrame:
    """Each message's first cause, chain by chain of six."""
    before = F.lag("global_seq").over(Window.partitionBy("stream_id").orderBy("version"))
    log = fx.log(spark, d)
    return saga.causation_roots(log.select(F.col("global_seq").alias("event_id"), F.when(F.col("version") % 6 != 1, before).alias("causation_id")))
