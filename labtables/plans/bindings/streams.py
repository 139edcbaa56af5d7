"""Streams over the events table, run until all of it is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtables.functions._cols import case_lookup
from labtables.operators import markers as M
from labtables.operators.routing import Rule
from labtables.operators.upsert import update_field
from labtables.plans.bindings._registry import ROLLUP_SQL, STAMP_SQL, query, stamp, table
from labtables.plans.bindings.documents import MISSING_SQL, REQUIRED, TARGET_SQL, raw_docs
from labtables.plans.bindings.documents import RULES as DOC_RULES
from labtables.plans.bindings.statuses import EVENT_STATUS, EVENT_STATUS_SQL
from labtables.plans.follow_projects import (
    SAMPLE_KEYS,
    follow_projects,
    project_table,
    rejected,
    sample_table,
)
from labtables.session import scratch_dir
from labtables.streaming import changes as C
from labtables.streaming.dispatch import Dispatcher
from labtables.streaming.markers import flowcell_ready as ready_stream
from labtables.streaming.rollup import follow_rollup, rolled_up

MARKERS = ["click", "purchase"]


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    # A pattern, since a stream's path must not be a single file.
    return C.read_changes(spark, f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet", schema)


#: Customers of a task that writes them out as documents, which are many times their size.
TASK_DOCS = 20_000


def _customer_docs(spark: SparkSession, sf_dir: str, customers: DataFrame) -> DataFrame:
    """Customers, dealt out while they are small, as documents."""
    tasks = max(1, -(-table(spark, sf_dir, "customer").count() // TASK_DOCS))
    return raw_docs(customers.repartition(tasks, "c_custkey"), table(spark, sf_dir, "nation"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, "events")


def _feed(events: DataFrame) -> DataFrame:
    """Events as document changes: the user is the document; sign-ups have no body."""
    body = F.to_json(F.struct(F.col("event_type").alias("method"), F.col("event_id").alias("n")))
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("doc_id"),
        F.when(F.col("event_type") != "signup", body).alias("body"),
    )


def _marker_files(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "event_id"
    )


COMPLETE_SQL = """
    SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type IN ('click', 'purchase')
    GROUP BY 1, 2 HAVING count(DISTINCT event_type) = 2
    """

# Step through each key's log: the state is the set seen so far (1 = click,
# 2 = purchase), an event is fired when it would become 3.
COMPLETIONS_SQL = """
    WITH RECURSIVE m AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day,
        CASE event_type WHEN 'click' THEN 1 ELSE 2 END AS bit,
        row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY event_id) AS rn
      FROM events WHERE event_type IN ('click', 'purchase')),
    walk AS (
      SELECT user_id, day, rn, bit AS seen, 0 AS fired FROM m WHERE rn = 1
      UNION ALL
      SELECT m.user_id, m.day, m.rn, CASE WHEN (w.seen | m.bit) = 3 THEN 0 ELSE w.seen | m.bit END,
             w.fired + CASE WHEN (w.seen | m.bit) = 3 THEN 1 ELSE 0 END
      FROM walk w JOIN m ON w.user_id = m.user_id AND w.day = m.day AND m.rn = w.rn + 1)
    SELECT user_id, day, CAST(max(fired) AS BIGINT) AS n_events FROM walk GROUP BY user_id, day HAVING max(fired) > 0
    """


@query(COMPLETE_SQL)
def flowcell_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _marker_files(table(spark, sf_dir, "events"))
    return M.complete_folders(files, ["user_id", "day"], "event_type", MARKERS)


@query(COMPLETIONS_SQL)
def flowcell_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _marker_files(table(spark, sf_dir, "events"))
    return M.completions(files, ["user_id", "day"], "event_type", MARKERS, "event_id")


@query(COMPLETIONS_SQL)
def flowcell_ready_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "flowcell-ready")
    fired = ready_stream(
        _marker_files(_event_stream(spark, sf_dir)), ["user_id", "day"], "event_type", MARKERS, "event_id"
    )
    (
        fired.writeStream.format("parquet")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{root}/out")
        .awaitTermination()
    )
    out = spark.read.schema(fired.schema).parquet(f"{root}/out")
    return out.groupBy("user_id", "day").agg(F.sum("n_events").alias("n_events"))


@query(
    """
    SELECT * FROM (SELECT CAST(user_id AS VARCHAR) AS doc_id, max(event_id) AS seq,
        arg_max(event_type, event_id) AS method FROM events GROUP BY user_id)
    WHERE method <> 'signup'
    """
)
def latest_doc_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "latest-docs")
    feed = _feed(_event_stream(spark, sf_dir))
    C.follow_documents(feed, f"{root}/checkpoint").awaitTermination()
    return C.latest_documents(spark, f"{root}/checkpoint").where("body IS NOT NULL").select(
        "doc_id", "seq", F.get_json_object("body", "$.method").alias("method")
    )


@query(
    """
    WITH f AS (SELECT * FROM events WHERE event_id > (SELECT floor(max(event_id) / 2) FROM events))
    SELECT * FROM (SELECT CAST(user_id AS VARCHAR) AS doc_id, max(event_id) AS seq,
        arg_max(event_type, event_id) AS method FROM f GROUP BY user_id)
    WHERE method <> 'signup'
    """
)
def changes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed from its middle, in two runs: the second goes on where the first ended."""
    root = scratch_dir(spark, "since")
    feed = _feed(table(spark, sf_dir, "events"))
    since = (feed.agg(F.max("seq")).first()[0] or 0) // 2
    for part in (0, 1):
        feed.where(F.col("seq") % 2 == part).write.mode("append").parquet(f"{root}/feed")
        changes = C.read_changes(spark, f"{root}/feed", since=since)
        C.follow_documents(changes, f"{root}/checkpoint").awaitTermination()
    return C.latest_documents(spark, f"{root}/checkpoint").where("body IS NOT NULL").select(
        "doc_id", "seq", F.get_json_object("body", "$.method").alias("method")
    )


STREAM_RULES = [Rule("click", "clicks"), Rule("p", "p_realm", prefix=True), Rule("v", "never")]


LAST_SQL = """
    SELECT * FROM (SELECT CAST(user_id AS VARCHAR) AS doc_id, max(event_id) AS seq,
        arg_max(event_type, event_id) AS method FROM events GROUP BY user_id)
    WHERE method <> 'signup'
"""


@query(
    f"""
    SELECT doc_id, seq, method, CASE method WHEN 'click' THEN 'clicks' WHEN 'purchase' THEN 'p_realm' END AS target
    FROM ({LAST_SQL}) WHERE method IN ('click', 'purchase')
    UNION ALL SELECT doc_id, seq, method, NULL FROM ({LAST_SQL}) WHERE method NOT IN ('click', 'purchase')
    """
)
def routed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed documents, and the unrouted ones with a null target."""
    checkpoint = f"{scratch_dir(spark, 'routed')}/checkpoint"
    feed = _feed(_event_stream(spark, sf_dir))
    C.follow_routed(feed, STREAM_RULES, "$.method", checkpoint).awaitTermination()
    routed, rejects = C.routed_documents(spark, checkpoint, STREAM_RULES, "$.method")
    columns = ["doc_id", "seq", "method"]
    return routed.select(*columns, "target").unionByName(
        rejects.select(*columns, F.lit(None).cast("string").alias("target"))
    )


@query(
    f"""
    WITH k AS (SELECT *, c_custkey AS k, {TARGET_SQL} AS target, c_custkey % 9 = 0 AS done,
        c_custkey % 3 = 0 AND c_custkey % 9 <> 0 AS changed, c_custkey % 6 <> 0 AS sequenced, c_custkey % 8 = 1 AS worked
      FROM customer WHERE {MISSING_SQL} = '' AND {TARGET_SQL} IS NOT NULL),
    s AS (SELECT k.*, sample_id FROM k, (VALUES ('S1'), ('S2')) AS t(sample_id) WHERE sample_id = 'S1' OR k % 2 <> 0)
    SELECT 'P' || CAST(k AS VARCHAR) AS project_id, target, CASE WHEN done THEN 'completed' ELSE 'ongoing' END AS tracked_status,
      CASE WHEN changed THEN 'new' ELSE 'own' END || CAST(k AS VARCHAR) AS owner_email, k % 4 = 0 AS sensitive, sample_id,
      CASE WHEN worked THEN 'processing' WHEN sequenced THEN 'initialized' ELSE 'unsequenced' END AS status,
      CASE WHEN sequenced THEN CASE WHEN changed THEN '20240301_' ELSE '20240101_' END || CAST(k AS VARCHAR) END AS flowcell,
      CASE WHEN NOT sequenced THEN '' ELSE '20240101_' || CAST(k AS VARCHAR) || ',' ||
        CASE WHEN changed THEN '20240301_' || CAST(k AS VARCHAR) || ',' ELSE '' END || '231231_A' END AS flowcells,
      CASE WHEN worked THEN 'at work' ELSE 'at intake' END AS start_time, '' AS end_time,
      CASE WHEN worked THEN 'Passed' ELSE '' END AS qc, false AS delivered,
      CASE WHEN worked OR sequenced THEN 'processing' ELSE 'pending' END AS project_status
    FROM s
    """
)
def project_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a document feed in two batches, with work on some samples in between.

    The second batch has new owners and flowcells for every third project; every ninth was
    completed before and stays as it is.
    """
    root = scratch_dir(spark, "projects")
    projects = project_table(spark, f"{root}/projects", buckets=8)
    samples = sample_table(spark, f"{root}/samples", buckets=8)
    docs = _customer_docs(spark, sf_dir, table(spark, sf_dir, "customer"))

    def catch_up() -> None:
        follow_projects(
            C.read_changes(spark, f"{root}/feed"),
            DOC_RULES,
            REQUIRED,
            projects,
            samples,
            f"{root}/checkpoint",
            now=F.lit("at intake"),
        ).awaitTermination()

    docs.write.mode("append").parquet(f"{root}/feed")
    catch_up()

    number = F.substr("project_id", F.lit(2)).cast("long")
    worked = samples.current().where(number % 8 == 1)
    patches = worked.select(
        *SAMPLE_KEYS,
        "seq",
        F.inline(
            F.array(
                F.struct(F.lit("status").alias("field"), F.lit("processing").alias("value")),
                F.struct(F.lit("qc").alias("field"), F.lit("Passed").alias("value")),
            )
        ),
    )
    samples.upsert(update_field(worked, patches, SAMPLE_KEYS, ["status", "qc"], "seq", F.lit("at work")))
    done = projects.current().where(number % 9 == 0).withColumn("project_status", F.lit("completed"))
    projects.upsert(done)

    changed = F.replace(
        F.replace("body", F.lit("20240101_"), F.lit("20240301_")), F.lit('"email":"own'), F.lit('"email":"new')
    )
    later = docs.where(F.col("seq") % 3 == 0).withColumn("body", changed)
    later.withColumn("seq", F.col("seq") + 1_000_000_000).write.mode("append").parquet(f"{root}/feed")
    catch_up()

    kept = samples.current()
    owner = F.try_element_at(F.try_element_at("user_info", F.lit("owner")), F.lit("email"))
    tracked = projects.current().select(
        "project_id", "target", F.col("project_status").alias("tracked_status"), owner.alias("owner_email"), "sensitive"
    )
    rolled = C.tracked_projects(kept, "project_id").drop("n_samples")
    return (
        kept.drop("seq", "job_id")
        .withColumn("flowcells", F.array_join(F.array_sort("flowcells"), ","))
        .join(tracked, "project_id")
        .join(rolled, "project_id")
    )


@query(
    f"""
    SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_custkey AS seq,
      CASE WHEN {MISSING_SQL} <> '' THEN 'incomplete' ELSE 'unrouted' END AS reason,
      CASE WHEN {MISSING_SQL} <> '' THEN {MISSING_SQL} ELSE c_mktsegment END AS detail
    FROM customer WHERE {MISSING_SQL} <> '' OR {TARGET_SQL} IS NULL
    """
)
def project_stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same feed: the documents that are not followed, with the reason."""
    root = scratch_dir(spark, "project-rejects")
    feed = _customer_docs(spark, sf_dir, _stream(spark, sf_dir, "customer"))
    C.follow_documents(feed, f"{root}/checkpoint").awaitTermination()
    return rejected(spark, f"{root}/checkpoint", DOC_RULES, REQUIRED)


def _status_log(events: DataFrame) -> DataFrame:
    return events.select(
        (F.col("user_id") % 40).alias("project_id"),
        F.col("user_id").alias("sample_id"),
        case_lookup("event_type", EVENT_STATUS).alias("status"),
        "event_id",
        "ts",
    )


STATUS_LAST_SQL = f"""SELECT user_id, arg_max({EVENT_STATUS_SQL}, event_id) AS st,
      max({STAMP_SQL.format('ts')}) FILTER (event_type IN ('click', 'view')) AS start_time,
      max({STAMP_SQL.format('ts')}) FILTER (event_type IN ('purchase', 'error')) AS end_time
    FROM events GROUP BY user_id"""


@query(
    f"""
    WITH s AS ({STATUS_LAST_SQL}),
    f AS (SELECT user_id % 40 AS project_id, bool_or(st IN ('processing')) AS a,
        bool_and(st IN ('completed')) AS b, bool_and(st IN ('pending')) AS c FROM s GROUP BY 1)
    SELECT project_id, user_id AS sample_id, st AS status, start_time, end_time,
      {ROLLUP_SQL.format(finished='completed')} AS project_status
    FROM f JOIN s ON project_id = user_id % 40
    """
)
def status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status rows in three batches that come in no order; each changes what is there."""
    root = scratch_dir(spark, "status")
    log = _status_log(table(spark, sf_dir, "events"))
    for batch in (1, 0, 2):
        log.where(F.col("event_id") % 3 == batch).write.mode("append").parquet(f"{root}/log")
        rows = C.read_changes(spark, f"{root}/log", log.schema)
        C.follow_status(
            rows, ["project_id", "sample_id"], "status", "event_id", "ts", f"{root}/checkpoint"
        ).awaitTermination()
    samples = C.current_statuses(spark, f"{root}/checkpoint")
    rolled = C.tracked_projects(samples, "project_id").drop("n_samples")
    return samples.join(rolled, "project_id").select(
        "project_id",
        "sample_id",
        "status",
        stamp("start_time").alias("start_time"),
        stamp("end_time").alias("end_time"),
        "project_status",
    )


@query(
    f"""
    WITH e AS (SELECT user_id % 40 AS p, event_id, ts,
        CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS k,
        lag(CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END)
          OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events),
    c AS (SELECT p, event_id, ts, sum(CASE WHEN was IS NULL THEN 1 ELSE 0 END) OVER w AS n,
        sum(CAST(k = 0 AS INT) - CAST(coalesce(was = 0, false) AS INT)) OVER w AS active,
        sum(CAST(k = 1 AS INT) - CAST(coalesce(was = 1, false) AS INT)) OVER w AS finished,
        sum(CAST(k = 2 AS INT) - CAST(coalesce(was = 2, false) AS INT)) OVER w AS idle
      FROM e WINDOW w AS (PARTITION BY p ORDER BY event_id)),
    s AS (SELECT p, event_id, ts, n, CASE WHEN active > 0 THEN 'processing' WHEN finished = n THEN 'completed'
        WHEN idle = n THEN 'pending' ELSE 'partially_completed' END AS st FROM c),
    l AS (SELECT p, max(event_id) FILTER (st = 'processing') AS cleared, max(n) AS n_samples,
        arg_max(st, event_id) AS project_status FROM s GROUP BY p),
    d AS (SELECT s.p, arg_min(s.ts, s.event_id) AS end_date FROM s JOIN l ON s.p = l.p
        WHERE s.st IN ('completed', 'partially_completed') AND s.event_id > coalesce(l.cleared, -1) GROUP BY s.p)
    SELECT CAST(l.p AS VARCHAR) AS project_id, CAST(n_samples AS BIGINT) AS n_samples, project_status,
      {STAMP_SQL.format('end_date')} AS end_date
    FROM l LEFT JOIN d ON l.p = d.p
    """
)
def rollup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project status and end date after each status row, in two batches."""
    root = scratch_dir(spark, "rollup")
    log = _status_log(table(spark, sf_dir, "events"))
    half = log.agg(F.median("event_id")).first()[0] or 0
    for batch in (F.col("event_id") <= half, F.col("event_id") > half):
        log.where(batch).write.mode("append").parquet(f"{root}/log")
        rows = C.read_changes(spark, f"{root}/log", log.schema)
        follow_rollup(rows, "project_id", "sample_id", "status", "event_id", "ts", f"{root}/kept")
    return rolled_up(spark, f"{root}/kept").select(
        F.col("project").alias("project_id"), "n_samples", "project_status", stamp("end_date").alias("end_date")
    )


@query(
    """
    SELECT event_type, count(*) AS n_rows, CAST(round(sum(value * 100)) AS BIGINT) AS total, 'handled' AS outcome
    FROM events WHERE event_type IN ('click', 'purchase') GROUP BY event_type
    UNION ALL SELECT event_type, count(*), 0, 'failed' FROM events WHERE event_type = 'view' GROUP BY event_type
    UNION ALL SELECT event_type, count(*), 0, 'unhandled' FROM events WHERE event_type IN ('error', 'signup') GROUP BY event_type
    """
)
def dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two handlers that work, one that fails, and two types without one."""
    root = scratch_dir(spark, "dispatch")
    dispatcher = Dispatcher(("click", "view", "purchase", "error", "signup"))

    def store(name: str):
        def handler(rows: DataFrame, batch_id: int) -> None:
            rows.groupBy("event_type").agg(
                F.count("*").alias("n_rows"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total")
            ).write.mode("overwrite").parquet(f"{root}/out/{name}/batch={batch_id}")

        return handler

    def broken(rows: DataFrame, batch_id: int) -> None:
        raise RuntimeError("handler is broken")

    dispatcher.register_handler("click", broken)
    dispatcher.register_handler("click", store("click"))
    dispatcher.register_handler("view", broken)
    dispatcher.register_handler("purchase", store("purchase"))
    events = _event_stream(spark, sf_dir)
    dispatcher.start(
        events,
        f"{root}/checkpoint",
        f"{root}/errors",
        replay_path=f"{root}/replay",
        unhandled_path=f"{root}/unhandled",
    ).awaitTermination()

    handled = (
        spark.read.schema("event_type STRING, n_rows BIGINT, total BIGINT")
        .parquet(f"{root}/out/*/*")
        .groupBy("event_type")
        .agg(F.sum("n_rows").alias("n_rows"), F.sum("total").alias("total"))
        .withColumn("outcome", F.lit("handled"))
    )
    zero = F.lit(0).cast("long")

    def kept(folder: str, outcome: str) -> DataFrame:
        rows = spark.read.schema("event_type STRING").parquet(f"{root}/{folder}/*")
        return rows.groupBy("event_type").agg(
            F.count("*").alias("n_rows"), zero.alias("total"), F.lit(outcome).alias("outcome")
        )

    return handled.unionByName(kept("replay", "failed")).unionByName(kept("unhandled", "unhandled"))
