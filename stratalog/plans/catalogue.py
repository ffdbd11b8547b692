"""The query catalogue over the test tables: each query with the SQL that must give the same rows.

Ordered scans carry their place as ``rn``, since rows are compared without their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Options
from ..operators import batch, compact, feed, log, lookup, scan, ttl
from ..shared import fresh_path
from ..sources import adapters as src
from ..sources import records
from ..table import Store

#: Fixed times of the queries: 2024-01-20 and 2024-01-31, in nanoseconds.
T20, T31 = 1_705_708_800_000_000_000, 1_706_659_200_000_000_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_OPS = """ops AS (SELECT event_id AS seq, epoch_us(ts) * 1000 AS t, event_id // 10 + 1 AS batch_id,
  CASE event_type WHEN 'signup' THEN 'put' WHEN 'view' THEN 'put_ttl' WHEN 'click' THEN 'expire' WHEN 'purchase' THEN 'persist' ELSE 'delete' END AS op,
  'user-' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS key, props AS value, CAST(round(value * 100) AS BIGINT) * 6000000000 AS ttl FROM events)"""
_FOLD = """g AS (SELECT *, CASE WHEN op IN ('put_ttl', 'expire') THEN t + ttl ELSE 0 END AS exp,
  sum(CASE WHEN op IN ('put', 'put_ttl', 'delete') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS grp FROM {source}),
b AS (SELECT *, lag(exp) OVER w AS pexp, first_value(op) OVER w AS bop, first_value(value) OVER w AS bval FROM g WINDOW w AS (PARTITION BY key, grp ORDER BY seq ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, max(CASE WHEN bop NOT IN ('put', 'put_ttl') OR (pexp > 0 AND pexp <= t) THEN 1 ELSE 0 END) OVER (PARTITION BY key, grp ORDER BY seq ROWS UNBOUNDED PRECEDING) AS dead FROM b)"""
_ROWS = """data AS (SELECT event_id * 2 AS seq, event_id // 1000 AS seg, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS record_type, event_id // 10 + 1 AS batch_id,
  'user-' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS key, CASE WHEN event_type <> 'error' THEN props END AS value,
  CASE WHEN event_type = 'view' THEN epoch_us(ts) * 1000 + CAST(round(value * 100) AS BIGINT) * 6000000000 ELSE 0 END AS expire_ns FROM events),
committed AS (SELECT * FROM data WHERE batch_id % 7 <> 0)"""
_LATEST = _ROWS + """, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM committed) WHERE n = 1),
indexed AS (SELECT key, value, expire_ns, seq, seg FROM newest WHERE record_type = 0),
live AS (SELECT * FROM indexed WHERE NOT (expire_ns > 0 AND expire_ns <= %d))""" % T31
_PAGES = "kv AS (SELECT url AS key, html AS value FROM pages)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.latest(log.committed(src.events_log(spark, sf_dir)))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.live(log.committed(src.events_log(spark, sf_dir)), T31)


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All users of the table, and as many that never are."""
    users = src.events_ops(spark, sf_dir).select("key").distinct()
    return users.select(F.explode(F.array("key", F.concat("key", F.lit("x")))).alias("key"))


_PROBES = "users AS (SELECT DISTINCT 'user-' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS key FROM events), probes AS (SELECT key FROM users UNION ALL SELECT key || 'x' FROM users)"


# State.


@query(f"WITH {_LATEST} SELECT key, value, expire_ns, seq FROM indexed")
def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir).select("key", "value", "expire_ns", "seq")


@query("""SELECT key, value, seq FROM (SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderpriority AS value, o_orderkey AS seq, o_orderstatus AS s,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1 AND s <> 'F'""")
def snapshot_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.latest(src.orders_log(spark, sf_dir)).select("key", "value", "seq")


@query(f"""WITH {_OPS}, past AS (SELECT * FROM ops WHERE t <= {T20}), {_FOLD.format(source='past')}
  SELECT key, bval AS value, exp AS expire_ns, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM d) WHERE n = 1 AND dead = 0 AND (exp = 0 OR exp > {T20})""")
def snapshot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ttl.state_as_of(src.events_ops(spark, sf_dir), T20)


@query(f"""WITH {_OPS}, {_FOLD.format(source='ops')}
  SELECT key, bval AS value, exp AS expire_ns, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM d) WHERE n = 1 AND dead = 0""")
def ttl_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ttl.fold(src.events_ops(spark, sf_dir))


@query(f"""WITH {_OPS}, {_FOLD.format(source='ops')}
  SELECT key, CASE WHEN exp = 0 THEN -1 ELSE exp - {T31} END AS ttl_ns FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM d) WHERE n = 1 AND dead = 0 AND (exp = 0 OR exp > {T31})""")
def ttl_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ttl.state_as_of(src.events_ops(spark, sf_dir), T31).select("key", ttl.remaining(T31).alias("ttl_ns"))


# Log.


@query(f"WITH {_ROWS} SELECT seq, seg, record_type, batch_id, key, value, expire_ns FROM data")
def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.events_log(spark, sf_dir).where("record_type <> 2").withColumn("record_type", F.col("record_type").cast("int"))


@query(f"WITH {_ROWS} SELECT seq, key, value FROM data WHERE seg <= 4")
def log_scan_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.segments(src.events_log(spark, sf_dir), up_to=4).where("record_type <> 2").select("seq", "key", "value")


@query(f"WITH {_ROWS} SELECT seq, key, value FROM data WHERE seg > 4")
def log_scan_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.segments(src.events_log(spark, sf_dir), after=4).where("record_type <> 2").select("seq", "key", "value")


@query(f"WITH {_ROWS} SELECT seq, batch_id, key, value, expire_ns FROM committed")
def committed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.committed(src.events_log(spark, sf_dir)).select("seq", "batch_id", "key", "value", "expire_ns")


@query(f"WITH {_ROWS} SELECT seq, batch_id, key FROM data WHERE batch_id % 7 = 0")
def torn_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.torn(src.events_log(spark, sf_dir)).select("seq", "batch_id", "key")


# Scans.


@query(f"WITH {_LATEST} SELECT key FROM indexed")
def keys_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.ascend_keys(_indexed(spark, sf_dir))


@query(f"WITH {_LATEST} SELECT key FROM live")
def keys_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.ascend_keys(_live(spark, sf_dir))


def _ordered(name: str, sql_where: str, rows: Callable[[DataFrame], DataFrame], reverse: bool, pages: bool, columns: str = "key, value") -> None:
    """Register a scan with its place: over live events keys, or over pages."""
    source, table = (_PAGES, "kv") if pages else (_LATEST, "live")
    order = "DESC" if reverse else "ASC"
    sql = f"WITH {source} SELECT {columns}, CAST(row_number() OVER (ORDER BY key {order}) AS BIGINT) AS rn FROM {table} WHERE {sql_where}"

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = src.pages_kv(spark, sf_dir) if pages else _live(spark, sf_dir)
        return scan.ranked(rows(base).select(*columns.split(", ")), reverse)

    f.__name__ = name
    query(sql)(f)


_A, _B, _LOW, _HIGH = "user-000000030", "user-000000100", "https://", "https://m"
_ordered("scan_asc", "true", scan.ascend, False, False)
_ordered("scan_desc", "true", scan.descend, True, False)
_ordered("scan_asc_pages", "true", scan.ascend, False, True)
_ordered("scan_desc_pages", "true", scan.descend, True, True)
_ordered("scan_range_asc", f"key >= '{_A}' AND key < '{_B}'", lambda r: scan.ascend_range(r, _A, _B), False, False)
_ordered("scan_range_desc", f"key <= '{_B}' AND key > '{_A}'", lambda r: scan.descend_range(r, _B, _A), True, False)
_ordered("scan_ge", f"key >= '{_B}'", lambda r: scan.ascend_greater_or_equal(r, _B), False, False)
_ordered("scan_le", f"key <= '{_A}'", lambda r: scan.descend_less_or_equal(r, _A), True, False)
_ordered("keys_regex_asc", "regexp_matches(key, '/en/[0-9]+$')", lambda r: scan.ascend_keys(r, "/en/[0-9]+$"), False, True, "key")
_ordered("keys_regex_desc", "regexp_matches(key, '^https?://[a-z]+[.]')", lambda r: scan.descend_keys(r, "^https?://[a-z]+[.]"), True, True, "key")
_ordered("keys_range_regex_asc", f"key >= '{_LOW}' AND key < '{_HIGH}' AND regexp_matches(key, 'blog')", lambda r: scan.ascend_keys_range(r, _LOW, _HIGH, "blog"), False, True, "key")
_ordered("keys_range_regex_desc", f"key <= '{_HIGH}' AND key > '{_LOW}' AND regexp_matches(key, '#top$')", lambda r: scan.descend_keys_range(r, _HIGH, _LOW, "#top$"), True, True, "key")
_ordered("iter_prefix", "starts_with(key, 'https://blog')", lambda r: scan.with_prefix(r, "https://blog"), False, True)
_ordered("iter_prefix_reverse", "starts_with(key, 'http://')", lambda r: scan.with_prefix(r, "http://", True), True, True)


@query("""SELECT source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS key, CAST(strlen(text) AS BIGINT) AS n FROM documents WHERE source = 'src1' AND lang = 'en'""")
def iter_prefix_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.with_prefix(src.documents_kv(spark, sf_dir), "src1/en/").select("key", F.octet_length("value").cast("long").alias("n"))


_SEEK = "probes AS (SELECT DISTINCT substr(url, 1, 12 + CAST(page_id % 9 AS INTEGER)) || CASE WHEN page_id % 2 = 0 THEN 'm' ELSE '' END AS probe FROM pages UNION SELECT '' UNION SELECT 'zzz')"


def _seek_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("page_id") % 2 == 0, "m").otherwise("")
    cut = src.read(spark, sf_dir, "pages").select(F.concat(F.substring("url", F.lit(1), (12 + F.col("page_id") % 9).cast("int")), tail).alias("probe"))
    return cut.union(spark.createDataFrame([("",), ("zzz",)], "probe string")).distinct()


@query(f"WITH {_PAGES}, {_SEEK} SELECT probe, (SELECT min(key) FROM kv WHERE key >= probe) AS key FROM probes")
def seek_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.seek(src.pages_kv(spark, sf_dir), _seek_probes(spark, sf_dir))


@query(f"WITH {_PAGES}, {_SEEK} SELECT probe, (SELECT max(key) FROM kv WHERE key <= probe) AS key FROM probes")
def seek_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.seek(src.pages_kv(spark, sf_dir), _seek_probes(spark, sf_dir), reverse=True)


@query(f"WITH {_PAGES} SELECT key, lead(key) OVER (ORDER BY key) AS next_key FROM kv")
def iter_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.successors(src.pages_kv(spark, sf_dir))


@query(f"WITH {_PAGES} SELECT key FROM kv ORDER BY key LIMIT 25")
def scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.ascend_keys(src.pages_kv(spark, sf_dir)).limit(25)


@query(f"""WITH {_PAGES} SELECT key FROM (SELECT key, coalesce(sum(strlen(value)) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM kv) WHERE before <= 100000""")
def scan_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.until_bytes(src.pages_kv(spark, sf_dir), 100_000).select("key")


# Point reads.


@query(f"WITH {_LATEST}, {_PROBES} SELECT key, value FROM probes JOIN live USING (key)")
def bulk_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.get(_live(spark, sf_dir), _probes(spark, sf_dir))


@query(f"WITH {_LATEST}, {_PROBES} SELECT key, key IN (SELECT key FROM live) AS found FROM probes")
def bulk_exist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.exist(_live(spark, sf_dir), _probes(spark, sf_dir))


@query(f"""WITH {_LATEST}, {_PROBES} SELECT p.key, CASE WHEN l.key IS NULL OR l.expire_ns = 0 THEN -1 ELSE l.expire_ns - {T31} END AS ttl_ns,
  CASE WHEN l.key IS NULL THEN 'not_found' ELSE 'ok' END AS status FROM probes p LEFT JOIN live l ON p.key = l.key""")
def bulk_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.ttl(_live(spark, sf_dir), _probes(spark, sf_dir), T31)


# Mutations.


def _status(op: str) -> None:
    fails = "dead = 1" if op != "delete" else "false"
    sql = f"WITH {_OPS}, {_FOLD.format(source='ops')} SELECT seq, key, CASE WHEN {fails} THEN 'not_found' ELSE 'ok' END AS status FROM d WHERE op = '{op}'"

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ttl.statuses(src.events_ops(spark, sf_dir), op)

    f.__name__ = f"{op}_status"
    query(sql)(f)


for _op in ("put", "put_ttl", "expire", "persist", "delete"):
    _status(_op)


@query(f"""WITH {_OPS} SELECT batch_id, key, op, seq FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, key ORDER BY seq DESC) AS n FROM ops) WHERE n = 1""")
def batch_last_op_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.last_op_wins(src.events_ops(spark, sf_dir)).select("batch_id", "key", "op", "seq")


@query(f"""WITH {_OPS}, kept AS (SELECT * FROM ops WHERE batch_id % 5 <> 0), {_FOLD.format(source='kept')}
  SELECT key, bval AS value, exp AS expire_ns, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM d) WHERE n = 1 AND dead = 0 AND (exp = 0 OR exp > {T31})""")
def batch_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = src.events_ops(spark, sf_dir)
    back = ops.where("batch_id % 5 = 0").select("batch_id")
    return ttl.state_as_of(batch.without_batches(ops, back), T31)


# Compaction, purge, statistics.


@query(f"WITH {_LATEST} SELECT key, value, expire_ns, seq FROM live")
def merge_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact.merge_live(src.events_log(spark, sf_dir), 2**31 - 1, T31).select("key", "value", "expire_ns", "seq")


@query(f"WITH {_LATEST} SELECT key, seq FROM live")
def merge_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact.hint(compact.merge_live(src.events_log(spark, sf_dir), 2**31 - 1, T31))


@query(f"""WITH {_LATEST}, k AS (SELECT seg, count(*) AS live FROM live GROUP BY seg), r AS (SELECT seg, count(*) AS records FROM data GROUP BY seg)
  SELECT CAST(r.seg AS INTEGER) AS seg, records, coalesce(live, 0) AS live, records - coalesce(live, 0) AS garbage FROM r LEFT JOIN k USING (seg)""")
def merge_garbage_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact.garbage_by_segment(src.events_log(spark, sf_dir), T31)


@query(f"WITH {_LATEST} SELECT key, value, expire_ns, seq FROM indexed")
def snapshot_plus_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equals the whole replay. The snapshot keeps expired keys here, since its time is before all expiries."""
    events = src.events_log(spark, sf_dir)
    snapshot = compact.merge_live(events, 4, 0)
    return log.override(snapshot, log.committed(log.segments(events, after=4))).select("key", "value", "expire_ns", "seq")


@query(f"WITH {_LATEST} SELECT (SELECT count(*) FROM indexed) AS before, (SELECT count(*) FROM live) AS after")
def purge_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _indexed(spark, sf_dir)
    return held.agg(F.count("*").alias("before"), F.count(F.when(~log.expired(T31), 1)).alias("after"))


@query(f"WITH {_LATEST}, page AS (SELECT key, expire_ns FROM indexed WHERE key >= 'user-000000020' ORDER BY key LIMIT 100) SELECT key FROM page WHERE expire_ns > 0 AND expire_ns <= {T31}")
def purge_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact.purge_page(_indexed(spark, sf_dir), T31, "user-000000020")


@query(f"""WITH {_LATEST}, marks AS (SELECT DISTINCT CAST(batch_id AS VARCHAR) AS key FROM committed)
  SELECT (SELECT count(*) FROM indexed) AS keys_num, CAST((SELECT sum(strlen(key) + coalesce(strlen(value), 0)) FROM data) + (SELECT sum(strlen(key)) FROM marks) AS BIGINT) AS disk_size""")
def stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact.stat(src.events_log(spark, sf_dir))


# The store itself: commits, compaction, reopening, the feed.


class _Times:
    """A clock that a query sets."""

    now = T20

    def __call__(self) -> int:
        return self.now


_STORED = f"""o AS (SELECT *, t > {T20} AS late FROM ops WHERE op IN ('put', 'put_ttl', 'delete')),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, late ORDER BY seq DESC) AS r, row_number() OVER (PARTITION BY key ORDER BY late DESC, seq DESC) AS r_all FROM o) WHERE r = 1)"""


def _stored(spark: SparkSession, sf_dir: str) -> tuple[Store, _Times, DataFrame]:
    """A store with the puts and deletes up to a time in one commit, and the later ones."""
    ops = src.events_ops(spark, sf_dir).where(F.col("op").isin("put", "put_ttl", "delete"))
    clock = _Times()
    store = Store.open(spark, Options(fresh_path(spark, "store"), segment_rows=1, watch_queue_size=1000), clock)
    store.write(ops.where(F.col("t_ns") <= T20), order="seq")
    return store, clock, ops.where(F.col("t_ns") > T20)


@query(f"""WITH {_OPS}, {_STORED} SELECT key, value FROM n WHERE r_all = 1 AND (op = 'put' OR (op = 'put_ttl' AND CASE WHEN late THEN {T31} ELSE {T20} END + ttl > {T31}))""")
def store_merge_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit, compact, commit, close, open again, compact, read."""
    store, clock, later = _stored(spark, sf_dir)
    store.merge()
    clock.now = T31
    store.write(later, order="seq")
    store.close()
    again = Store.open(spark, store.options, clock)
    again.merge()
    return again.ascend().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query(f"""WITH {_OPS}, {_STORED}, f AS (SELECT * FROM n WHERE NOT late)
  SELECT CASE WHEN op = 'delete' THEN 1 ELSE 0 END AS action, key, CASE WHEN op <> 'delete' THEN value END AS value FROM f
  UNION ALL SELECT 0, key, value FROM f WHERE op = 'put' OR (op = 'put_ttl' AND ttl > 0)""")
def store_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of two commits; the second one's expires carry the values of their keys."""
    store, _, _ = _stored(spark, sf_dir)
    store.write(store.live().select(F.lit("expire").alias("op"), "key", F.lit(None).cast("binary").alias("value"), F.lit(10**9).alias("ttl_ns")))
    return store.events().select(F.col("action").cast("int").alias("action"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query(f"""WITH {_OPS}, {_STORED}, f AS (SELECT * FROM n WHERE NOT late AND op <> 'delete') SELECT count(*) FILTER (op = 'put_ttl' AND {T20} + ttl <= {T31}) AS purged,
  count(*) FILTER (op = 'put' OR {T20} + ttl > {T31}) AS keys_num FROM f""")
def store_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a purge takes out of the index, and those that stay."""
    store, clock, _ = _stored(spark, sf_dir)
    clock.now = T31
    purged = store.delete_expired_keys()
    return store.indexed().agg(F.lit(purged).cast("long").alias("purged"), F.count("*").alias("keys_num"))


@query(f"""WITH {_OPS}, {_STORED} SELECT CAST(late AS INTEGER) AS seg, count(*) AS records,
  count(*) FILTER (r_all = 1 AND (op = 'put' OR (op = 'put_ttl' AND CASE WHEN late THEN {T31} ELSE {T20} END + ttl > {T31}))) AS live FROM n GROUP BY late""")
def store_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and live ones of each segment; every commit is one here."""
    store, clock, later = _stored(spark, sf_dir)
    clock.now = T31
    store.write(later, order="seq")
    return store.garbage()


@query(f"""WITH {_OPS}, {_STORED} SELECT key, CAST(late AS INTEGER) AS seg FROM n WHERE r_all = 1 AND op <> 'delete'""")
def store_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment that each indexed key's state comes from."""
    store, clock, later = _stored(spark, sf_dir)
    clock.now = T31
    store.write(later, order="seq")
    return store.positions().select(F.col("key").cast("string").alias("key"), "seg")


@query(f"""WITH {_ROWS} SELECT CAST(seg AS INTEGER) AS seg, record_type, batch_id, key, coalesce(value, '') AS value, expire_ns FROM data""")
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written in the binary encoding, a file a segment, and read back."""
    folder = fresh_path(spark, "records")
    records.write_segments(src.events_log(spark, sf_dir), folder)
    read = records.read_segments(spark, folder).where("record_type <> 2")
    return read.select("seg", F.col("record_type").cast("int").alias("record_type"), "batch_id", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "expire_ns")


# Change feed.


@query(f"WITH {_ROWS} SELECT CAST(record_type AS INTEGER) AS action, key, value, batch_id, seq FROM committed")
def feed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.events(src.events_log(spark, sf_dir)).withColumn("action", F.col("action").cast("int"))


@query(f"""WITH {_ROWS} SELECT batch_id, CAST(sum(1 - record_type) AS BIGINT) AS n_puts, CAST(sum(record_type) AS BIGINT) AS n_deletes, min(seq) AS first_seq, max(seq) AS last_seq FROM committed GROUP BY batch_id""")
def feed_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.batch_summary(feed.events(src.events_log(spark, sf_dir)))


@query(f"WITH {_ROWS} SELECT CAST(record_type AS INTEGER) AS action, key, seq FROM committed ORDER BY seq DESC LIMIT 998")
def feed_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.bounded(feed.events(src.events_log(spark, sf_dir)), 1000).select(F.col("action").cast("int").alias("action"), "key", "seq")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations folded to the live state at a time, in key order."""
    return scan.ascend(ttl.state_as_of(src.events_ops(spark, sf_dir), T20))
