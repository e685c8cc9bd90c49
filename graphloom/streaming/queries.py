"""Stateful processing of task events as structured streams.

Each function takes a stream, or a table, of events; :func:`replay` runs one over a folder of files as a stream of
whatever is available and returns what it has written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import model as m
from graphloom.catalog import query
from graphloom.operators.relational import sql
from graphloom.plans.scratch import few, scratch_path


def replay(spark: SparkSession, sf_dir: str, name: str, step: Callable[[DataFrame], DataFrame], mode: str = "complete") -> DataFrame:
    """Stream ``name``'s file through ``step`` into a table of the shared folder; progress survives a restart.

    Complete results overwrite the table; appended ones are written exactly once.
    """
    folder = scratch_path(spark, "stream")
    schema = m.table(spark, sf_dir, name).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    out = step(stream)
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    if mode == "append":
        started = writer.format("parquet").option("path", f"{folder}/out").start()
    else:
        def put(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out")

        started = writer.foreachBatch(put).start()
    started.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


# ---- stream steps --------------------------------------------------------------------------


def stage_progress(events: DataFrame) -> DataFrame:
    """Per user and kind: how many, their values' sum and mean, last activity."""
    return events.groupBy("user_id", "event_type").agg(
        F.count("*").alias("processed"), F.round(F.sum("value"), 2).alias("total_value"), (F.round(F.sum("value") * 100) / F.count("*")).alias("avg_cents"), F.max("event_id").alias("last_event"), F.max("ts").alias("last_activity")
    )


def triggered(events: DataFrame, triggers: DataFrame) -> DataFrame:
    """Event and trigger pairs whose kind and least value fit; triggers are a static table of definitions."""
    fits = (F.col("want_type").isNull() | (F.col("want_type") == F.col("event_type"))) & (F.col("value") >= F.col("least_value"))
    return events.join(few(triggers), fits).select("event_id", "trigger_id", "priority")


def fan_in(events: DataFrame, size: int) -> DataFrame:
    """(user_id, finished_at) once per job: when ``size`` of its tasks have ended, failed ones too.

    The job's state is its count and whether it was claimed, so exactly one event claims it.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class Counter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("job", "ended int, claimed boolean")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            ended, claimed = self.state.get() if self.state.exists() else (0, False)
            for frame in rows:
                for event in sorted(frame["event_id"].tolist()):
                    ended += 1
                    if ended >= size and not claimed:
                        claimed = True
                        yield pd.DataFrame({"user_id": [key[0]], "finished_at": [event]})
            self.state.update((ended, claimed))

        def close(self) -> None:
            pass

    return events.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Counter(), outputStructType="user_id bigint, finished_at bigint", outputMode="Append", timeMode="None")


def folded(events: DataFrame, key: str, state: str, start: tuple, step: Callable[[tuple, dict], tuple[tuple, list[tuple]]], out: str) -> DataFrame:
    """Rows (``key``, *``out``) that ``step`` emits: it takes a key's state and an event to the next state and rows.

    Events of a key that come together are taken by event_id. The state, of fixed size, is all that is kept of a key.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    names = [key, *[c.split()[0] for c in out.split(", ")]]

    class Fold(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("state", state)

        def handleInputRows(self, k, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            now = tuple(self.state.get()) if self.state.exists() else start
            found = []
            for event in sorted((e for frame in rows for e in frame.to_dict("records")), key=lambda e: e["event_id"]):
                now, more = step(now, event)
                found += [(k[0], *m) for m in more]
            self.state.update(now)
            if found:
                yield pd.DataFrame(found, columns=names)

        def close(self) -> None:
            pass

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).transformWithStateInPandas(statefulProcessor=Fold(), outputStructType=f"{key} {kind}, {out}", outputMode="Append", timeMode="None")


#: Status changes that may be made.
TRANSITIONS = {("view", "click"), ("click", "purchase"), ("click", "error"), ("error", "view"), ("purchase", "view")}


def compare_and_set(state: tuple, event: dict) -> tuple[tuple, list[tuple]]:
    """A change counts if the status is still the expected one and may become the new one."""
    (now,) = state
    fine = event["expected"] == now and (now, event["wanted"]) in TRANSITIONS
    after = event["wanted"] if fine else now
    return (after,), [(int(event["event_id"]), bool(fine), after)]


#: Failures in a row that trip a probe, and passes in a row of all tripped probes that clear an automatic pause.
TRIP, CLEAR, PROBES = 3, 3, 3


def pausing(state: tuple, event: dict) -> tuple[tuple, list[tuple]]:
    """Pauses by probes: ``TRIP`` failures of one in a row pause; ``CLEAR`` passes in a row of each that tripped resume, unless a user paused or a failure can't be recovered from.

    A user's pause is never taken over or lifted by probes; their resume lifts everything. Emits each change of the pause.
    """
    fails, passes, tripped, paused, blocked = list(state[:PROBES]), list(state[PROBES : 2 * PROBES]), list(state[2 * PROBES : 3 * PROBES]), state[-2], state[-1]
    before, k = paused, int(event["probe"])
    if event["kind"] == "pause":
        paused = "user"
    elif event["kind"] == "resume":
        paused, blocked, tripped, fails = "", False, [False] * PROBES, [0] * PROBES
    elif event["kind"] in ("fail", "fatal"):
        fails[k], passes[k] = fails[k] + 1, 0
        blocked = blocked or event["kind"] == "fatal"
        if fails[k] >= TRIP or event["kind"] == "fatal":
            tripped[k] = True
            paused = paused or "auto"
    else:
        fails[k], passes[k] = 0, passes[k] + 1
        if paused == "auto" and not blocked and all(p >= CLEAR for p, t in zip(passes, tripped, strict=True) if t):
            paused, tripped = "", [False] * PROBES
    out = [(int(event["event_id"]), before, paused)] if paused != before else []
    return (*fails, *passes, *tripped, paused, blocked), out


PAUSE_STATE = ", ".join([*[f"f{k} int" for k in range(PROBES)], *[f"p{k} int" for k in range(PROBES)], *[f"t{k} boolean" for k in range(PROBES)], "paused string, blocked boolean"])
PAUSE_START = (0,) * (2 * PROBES) + (False,) * PROBES + ("", False)


def probe_events(events: DataFrame) -> DataFrame:
    """Events as results of probes of ten systems, with users' pauses and failures that can't be recovered from among them."""
    e = F.col("event_id")
    kind = F.when(e % 97 == 0, "pause").when(e % 53 == 0, "resume").when((F.col("event_type") == "error") & (e % 41 == 0), "fatal").when(F.col("event_type").isin("error", "purchase"), "fail").otherwise("pass")
    return events.select((F.col("user_id") % 10).alias("system"), "event_id", (e % PROBES).alias("probe"), kind.alias("kind"))


def windowed(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """An extension beyond the graph operators: counts by day, late events dropped after ``late``."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), "event_type", "n")


def idle(events: DataFrame, key: str, hours: float, late: str = "2 hours") -> DataFrame:
    """(``key``, last_activity, stuck_at): each activity that none of its key follows within ``hours``, once the watermark has passed that time.

    A key has a timer for the earliest of its activities that nothing follows yet; what fires takes all that are due and sets the next. The state, read and written once a
    batch, holds the times that nothing follows yet and those that the watermark hasn't passed: an earlier time could still come and be followed by them.
    Events within the delay may come in any order, those that are later are dropped.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    of, span = key, int(hours * 3_600_000_000)
    due_ms = lambda at: -(-(at + span) // 1000)

    class Idle(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.open = handle, handle.getValueState("open", "at array<bigint>")

        def known(self) -> set[int]:
            return set(self.open.get()[0]) if self.open.exists() else set()

        def settle(self, known: set[int], passed: int) -> list[int]:
            """Those of the sorted ``known`` that nothing follows and whose time has passed; the others that matter are kept, with a timer for the earliest that nothing follows."""
            times = sorted(known)
            alone = [at for at, after in zip(times, [*times, None][1:], strict=True) if after is None or after > at + span]
            found = [at for at in alone if due_ms(at) <= passed]
            waiting = [at for at in alone if due_ms(at) > passed]
            kept = sorted({*waiting, *(at for at in times if at >= passed * 1000)})
            if kept:
                self.open.update((kept,))
            else:
                self.open.clear()
            if waiting:
                self.handle.registerTimer(due_ms(waiting[0]))
            return found

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            fresh = {int(at) for frame in rows for at in frame["at"]}
            found = self.settle(self.known() | fresh, timerValues.getCurrentWatermarkInMs())
            if found:
                yield pd.DataFrame({of: [key[0]] * len(found), "at": found})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            found = self.settle(self.known(), timerValues.getCurrentWatermarkInMs())
            if found:
                yield pd.DataFrame({of: [key[0]] * len(found), "at": found})

        def close(self) -> None:
            pass

    kind = dict(events.dtypes)[key]
    timed = events.select(key, F.col("ts").cast("timestamp").alias("ts")).withColumn("at", F.unix_micros("ts")).withWatermark("ts", late)
    out = timed.groupBy(key).transformWithStateInPandas(statefulProcessor=Idle(), outputStructType=f"{key} {kind}, at bigint", outputMode="Append", timeMode="EventTime")
    return out.select(key, F.timestamp_micros("at").alias("last_activity"), F.timestamp_micros(F.col("at") + span).alias("stuck_at"))


def sliding(events: DataFrame, length: str = "6 hours", step: str = "2 hours", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): counts and sums of values in windows that overlap, each once it is closed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")).select(F.col("w.start").alias("start"), "event_type", "n", "cents")


def sessions(events: DataFrame, key: str, gap: str = "8 hours", late: str = "2 hours") -> DataFrame:
    """(``key``, start, end, n): runs of events with less than ``gap`` between them, each once it is over."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def replay_in_turn(spark: SparkSession, parts: list[DataFrame], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stream ``parts`` one after the other, a batch each, through ``step``; what it appends is written exactly once."""
    folder = scratch_path(spark, "stream")
    for n, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{folder}/in/part={n}")  # a later part has later files, which streams take in that order
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/part=*")
    out = step(stream)
    started = out.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start()
    started.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


# ---- queries -------------------------------------------------------------------------------


@query("stage_progress", "SELECT user_id, event_type, count(*) AS processed, round(sum(value), 2) AS total_value, round(sum(value) * 100) / count(*) AS avg_cents, max(event_id) AS last_event, max(ts) AS last_activity FROM events GROUP BY user_id, event_type")
def stage_progress_query(spark, d):
    return replay(spark, d, "events", stage_progress)


@query("trigger_match", "SELECT event_id, trigger_id, priority FROM events JOIN (VALUES (1, 'error', 50, 1), (2, NULL, 150, 2), (3, 'purchase', 0, 3)) t(trigger_id, want_type, least_value, priority) ON (want_type IS NULL OR want_type = event_type) AND value >= least_value")
def trigger_match(spark, d):
    triggers = spark.createDataFrame([(1, "error", 50, 1), (2, None, 150, 2), (3, "purchase", 0, 3)], "trigger_id int, want_type string, least_value int, priority int")
    return replay(spark, d, "events", lambda e: triggered(e, triggers), "append")


@query("job_fan_in")
def job_fan_in(spark, d):
    # state with several columns is kept by this provider alone
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return replay(spark, d, "events", lambda e: fan_in(e.where(F.col("event_type").isin("purchase", "error")), 10), "append")


@query("job_fan_in_batch", "SELECT user_id, event_id AS finished_at FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type IN ('purchase', 'error')) WHERE k = 10")
def job_fan_in_batch(spark, d):
    e = m.table(spark, d, "events").where(F.col("event_type").isin("purchase", "error"))
    return e.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("k = 10").select("user_id", F.col("event_id").alias("finished_at"))


@query("window_counts", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window_counts(spark, d):
    return replay(spark, d, "events", windowed)


@query("auto_embed_debounce", "SELECT user_id, count(*) AS embedded FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id")
def auto_embed_debounce(spark, d):
    """What was embedded within the last month isn't again; older keys leave the state."""
    once = lambda e: e.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "31 days").dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")
    return replay(spark, d, "events", once, "append").groupBy("user_id").agg(F.count("*").alias("embedded"))


def _stateful(spark: SparkSession) -> None:
    """State with several columns is kept by this provider alone."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query("status_cas", """WITH e AS (SELECT user_id, list({'s': '', 'n': 0, 'x': ['view', 'click', 'purchase'][event_id % 3 + 1], 'w': event_type} ORDER BY event_id) AS es FROM events GROUP BY user_id),
  f AS (SELECT user_id, list_reduce(list_prepend({'s': 'view', 'n': 0, 'x': '', 'w': ''}, es), lambda a, e: CASE WHEN e.x = a.s AND a.s || '>' || e.w IN ('view>click', 'click>purchase', 'click>error', 'error>view', 'purchase>view') THEN {'s': e.w, 'n': a.n + 1, 'x': '', 'w': ''} ELSE {'s': a.s, 'n': a.n, 'x': '', 'w': ''} END) AS r FROM e)
  SELECT user_id, r.s AS status, CAST(r.n AS BIGINT) AS accepted FROM f""")
def status_cas(spark, d):
    """Each user's status after all changes, each of which expects a status."""
    _stateful(spark)
    expected = F.get(F.array(F.lit("view"), F.lit("click"), F.lit("purchase")), (F.col("event_id") % 3).cast("int"))
    asked = lambda e: e.select("user_id", "event_id", expected.alias("expected"), F.col("event_type").alias("wanted"))
    done = replay(spark, d, "events", lambda e: folded(asked(e), "user_id", "status string", ("view",), compare_and_set, "event_id bigint, accepted boolean, status string"), "append")
    return done.groupBy("user_id").agg(F.max_by("status", "event_id").alias("status"), F.count_if("accepted").alias("accepted"))


@query("stuck_detection", "SELECT user_id, max(ts) < TIMESTAMP '2024-01-30 12:00:00' AS stuck FROM events GROUP BY user_id")
def stuck_detection(spark, d):
    return m.table(spark, d, "events").groupBy("user_id").agg((F.max("ts") < F.lit("2024-01-30 12:00:00").cast("timestamp")).alias("stuck"))


@query("queue_reconcile", "SELECT count(*) FILTER (WHERE event_type = 'click') AS claimed, count(*) FILTER (WHERE event_type = 'click' AND next IS NULL) AS requeued FROM (SELECT event_type, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events)")
def queue_reconcile(spark, d):
    """Claimed tasks that nothing followed go back to the queue."""
    e = m.table(spark, d, "events").withColumn("next", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id")))
    claimed = F.col("event_type") == "click"
    return e.agg(F.count_if(claimed).alias("claimed"), F.count_if(claimed & F.col("next").isNull()).alias("requeued"))


@query("queue_task_page", "SELECT event_id, user_id, CAST(ceil((SELECT count(*) FROM events WHERE event_type = 'error') / 25) AS BIGINT) AS pages FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 25")
def queue_task_page(spark, d):
    from graphloom.operators.relational import page

    e = m.table(spark, d, "events").where("event_type = 'error'").select("event_id", "user_id")
    return page(e, [F.desc("event_id")], 0, 25).select("event_id", "user_id", F.ceil(F.col("total") / 25).alias("pages"))


@query("log_merge", "SELECT event_id, 'svc' || (user_id % 3) AS service, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def log_merge(spark, d):
    """The newest lines of all services' logs: service and time are read out of the line."""
    e = m.table(spark, d, "events")
    line = F.concat(F.lit("[svc"), F.col("user_id") % 3, F.lit("] "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" "), "event_type")
    read = e.select("event_id", line.alias("line")).select(
        "event_id", F.regexp_extract("line", r"^\[([a-z0-9]+)\]", 1).alias("service"), F.regexp_extract("line", r"([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9:]{8}\.[0-9]{6})", 1).alias("_at")
    )
    return read.orderBy(F.desc("_at"), F.desc("event_id")).limit(50).select("event_id", "service", F.substring("_at", 1, 19).alias("at"))


@query("health_error_rate", "SELECT user_id, CASE WHEN n < 20 THEN 'ok' WHEN f / n >= 0.8 THEN 'error' WHEN f / n >= 0.5 THEN 'warning' ELSE 'ok' END AS health FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type IN ('error', 'view', 'click')) AS f FROM events GROUP BY user_id)")
def health_error_rate(spark, d):
    e = m.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type").isin("error", "view", "click")).alias("f"))
    rate = F.col("f") / F.col("n")
    return e.select("user_id", F.when(F.col("n") < 20, "ok").when(rate >= 0.8, "error").when(rate >= 0.5, "warning").otherwise("ok").alias("health"))


@query("health_pause")
def health_pause(spark, d):
    """Changes of each system's pause; tested against a plain loop."""
    _stateful(spark)
    return replay(spark, d, "events", lambda e: folded(probe_events(e), "system", PAUSE_STATE, PAUSE_START, pausing, "event_id bigint, before string, after string"), "append")


@query("health_trips", "SELECT user_id, count(*) FILTER (WHERE run = 3) AS trips FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) AS run FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY event_id) AS g FROM events) WHERE event_type = 'error') GROUP BY user_id")
def health_trips(spark, d):
    """How often three errors in a row trip the pause: runs are islands between gaps."""
    by = Window.partitionBy("user_id").orderBy("event_id")
    e = m.table(spark, d, "events").withColumn("error", F.col("event_type") == "error")
    e = e.withColumn("g", F.row_number().over(by) - F.row_number().over(Window.partitionBy("user_id", "error").orderBy("event_id"))).where("error")
    return e.groupBy("user_id", "g").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count_if(F.col("n") >= 3).alias("trips"))


@query("llm_spend_cap", sql("""WITH u AS (SELECT id, day, source_id, sum(input_tokens) OVER (PARTITION BY day ORDER BY id) AS all_used, sum(input_tokens) OVER (PARTITION BY day, source_id ORDER BY id) AS own_used FROM metrics)
  SELECT id, day, source_id, CASE WHEN all_used > 100000 THEN 'day' ELSE 'source' END AS cap FROM u WHERE all_used > 100000 OR own_used > 6000"""))
def llm_spend_cap(spark, d):
    """Calls past the cap of their day, or of their source on that day."""
    x = m.metrics(spark, d)
    used = F.sum("input_tokens").over(Window.partitionBy("day").orderBy("id"))
    own = F.sum("input_tokens").over(Window.partitionBy("day", "source_id").orderBy("id"))
    over = x.select("id", "day", "source_id", used.alias("used"), own.alias("own")).where("used > 100000 or own > 6000")
    return over.select("id", "day", "source_id", F.when(F.col("used") > 100000, "day").otherwise("source").alias("cap"))


#: Failures that may pass by themselves, tries of a task, and seconds before the first retry and the longest wait.
TRANSIENT, TRIES, FIRST_WAIT, LONGEST_WAIT = ("timeout", "rate_limit"), 3, 5, 300


@query("queue_retry_classify", sql("""WITH f AS (SELECT id, error_type, row_number() OVER (PARTITION BY source_id, error_type ORDER BY id) AS attempt FROM metrics WHERE NOT success)
  SELECT id, CASE WHEN error_type NOT IN ('timeout', 'rate_limit') THEN 'fail' WHEN attempt >= 3 THEN 'dead' ELSE 'retry' END AS action, CASE WHEN error_type IN ('timeout', 'rate_limit') AND attempt < 3 THEN CAST(least(300, 5 * power(2, attempt - 1)) * CASE WHEN error_type = 'rate_limit' THEN 4 ELSE 1 END AS BIGINT) END AS wait FROM f"""))
def queue_retry_classify(spark, d):
    """What becomes of each failed call, and the seconds it waits: doubled by attempt, four times as long after a rate limit."""
    attempt = F.row_number().over(Window.partitionBy("source_id", "error_type").orderBy("id"))
    f = m.metrics(spark, d).where("not success").select("id", "error_type", attempt.alias("attempt"))
    passing = F.col("error_type").isin(*TRANSIENT)
    wait = F.least(F.lit(LONGEST_WAIT), FIRST_WAIT * F.pow(F.lit(2), F.col("attempt") - 1)) * F.when(F.col("error_type") == "rate_limit", 4).otherwise(1)
    action = F.when(~passing, "fail").when(F.col("attempt") >= TRIES, "dead").otherwise("retry")
    return f.select("id", action.alias("action"), F.when(action == "retry", wait.cast("bigint")).alias("wait"))


@query("queue_rehydrate", "SELECT user_id, max(event_id) AS task FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) IN ('view', 'click')")
def queue_rehydrate(spark, d):
    """The queue rebuilt from the log: tasks whose last event isn't an end."""
    last = m.table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("event_id", "event_type")).alias("x"))
    return last.where(F.col("x.event_type").isin("view", "click")).select("user_id", F.col("x.event_id").alias("task"))


# Three parts by time; one event in forty of the first three days comes only with the last part, too late.
_LATE = "event_id % 40 = 7 AND ts < TIMESTAMP_NTZ '2024-01-04 00:00:00'"
_TIMELY = "e AS MATERIALIZED (SELECT * FROM events WHERE NOT (event_id % 40 = 7 AND ts < TIMESTAMP '2024-01-04 00:00:00')), wm AS (SELECT max(ts) - INTERVAL 2 HOUR AS wm FROM e)"


def _parts(spark, d) -> list[DataFrame]:
    """The events of two ten days each and the rest; within a part they come in any order."""
    e = m.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    late = F.expr(_LATE)
    cuts = [F.lit(f"2024-01-{day}").cast("timestamp_ntz") for day in (11, 21)]
    return [e.where((F.col("ts") < cuts[0]) & ~late), e.where((F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1])), e.where((F.col("ts") >= cuts[1]) | late)]


@query("stuck_by_timer", f"""WITH {_TIMELY}, t AS (SELECT DISTINCT user_id, ts FROM e), n AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM t)
  SELECT user_id, ts AS last_activity, ts + INTERVAL 24 HOUR AS stuck_at FROM n, wm WHERE (next IS NULL OR next > ts + INTERVAL 24 HOUR) AND ts + INTERVAL 24 HOUR <= wm""")
def stuck_by_timer(spark, d):
    """Activities that nothing followed within a day, by timers over three batches with late events among them."""
    _stateful(spark)
    plain = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return replay_in_turn(spark, _parts(spark, d), lambda e: idle(e, "user_id", 24)).select("user_id", plain("last_activity"), plain("stuck_at"))


@query("window_sliding", f"""WITH {_TIMELY}, w AS (SELECT event_type, value, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '2024-01-01') - k * INTERVAL 2 HOUR AS start FROM e, range(3) r(k))
  SELECT start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM w, wm WHERE start + INTERVAL 6 HOUR <= wm GROUP BY 1, 2""")
def window_sliding(spark, d):
    return replay_in_turn(spark, _parts(spark, d), sliding).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("window_session", f"""WITH {_TIMELY}, s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER o < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS first FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 8 HOUR AS "end", count(*) AS n FROM k, wm GROUP BY user_id, k, wm HAVING max(ts) + INTERVAL 8 HOUR <= wm""")
def window_session(spark, d):
    plain = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return replay_in_turn(spark, _parts(spark, d), lambda e: sessions(e, "user_id")).select("user_id", plain("start"), plain("end"), "n")
