"""Sequential rules per key, as state processors for streams and as sorted folds for history.

The rules themselves are small classes with a ``step`` and named columns of ``memory``.  ``fold_sorted`` runs one
over history: rows are hash partitioned by key, sorted, and passed to the rule
batch by batch, so a long key costs time, not memory.
``processor`` runs the same rule on a stream with its state in the state store;
a micro-batch bounds how many rows of a key are looked at together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tidemark.operators.skew import _same_group, chunked_running, chunked_running_sum, first_at_or_after, spaced_firsts, walked
from tidemark.session import cut_lineage

Rule = Callable[[], Any]


class DedupWindow:
    """Requests with one key inside a window join the accepted run; a cancelled run blocks nobody.

    Rows: ms, seq, cancelled.  The window starts at the accepted run.
    """

    fields = "status string, joined bigint"
    memory = "at bigint, owner bigint"

    def __init__(self, window_ms: int):
        self.window_ms, self.at, self.owner = window_ms, None, None

    def step(self, row) -> tuple:
        if pd.isna(getattr(row, "dedup_key", "")):
            return "accepted", row.seq  # a request without a key joins nobody
        if self.at is not None and row.ms - self.at <= self.window_ms:
            return "deduplicated", self.owner
        if not row.cancelled:
            self.at, self.owner = row.ms, row.seq
        return "accepted", row.seq


class Circuit:
    """Closed, open after N failures in a row, one probe after the cool-down.

    Rows: ms, op in check / success / failure, anything else gives a probe back.  A half-open circuit
    is ``ready`` for its probe or ``probing``.
    """

    fields = "state string, failures int, allowed boolean, retry_after_ms bigint"
    memory = "phase string, failures int, opened bigint"
    PROBE_WAIT_MS = 1000
    # phase, what happens: next phase, is the caller let through, does it count as a failure
    MOVES = {
        ("closed", "check"): ("closed", True, 0),
        ("closed", "failure"): ("closed", None, 1),
        ("closed", "last failure"): ("open", None, 1),
        ("open", "early check"): ("open", False, 0),
        ("open", "check"): ("probing", True, 0),
        ("open", "failure"): ("open", None, 1),
        ("open", "last failure"): ("open", None, 1),
        ("ready", "check"): ("probing", True, 0),
        ("ready", "failure"): ("open", None, 0),
        ("ready", "last failure"): ("open", None, 0),
        ("probing", "check"): ("probing", False, 0),
        ("probing", "failure"): ("open", None, 0),
        ("probing", "last failure"): ("open", None, 0),
        ("probing", "release"): ("ready", None, 0),
    }

    def __init__(self, threshold: int = 5, cooldown_ms: int = 30_000):
        self.threshold, self.cooldown_ms = threshold, cooldown_ms
        self.phase, self.failures, self.opened = "closed", 0, None

    def step(self, row) -> tuple:
        if row.op == "success":
            self.phase, self.failures, self.opened = "closed", 0, None
            return "closed", 0, None, None
        what = row.op if row.op in ("check", "failure") else "release"
        left = 0 if self.phase != "open" else self.opened + self.cooldown_ms - row.ms
        if what == "check" and left > 0:
            what = "early check"
        if what == "failure" and self.failures + 1 >= self.threshold:
            what = "last failure"
        before = self.phase
        self.phase, allowed, counted = self.MOVES.get((before, what), (before, None, 0))
        self.failures += counted
        if self.phase == "open" != before:
            self.opened = row.ms
        wait = None if allowed is not False else left if left > 0 else self.PROBE_WAIT_MS
        return self.phase if self.phase in ("closed", "open") else "half-open", self.failures, allowed, wait


class Ledger:
    """Idempotency ledger of one key: claim / complete / release with leases and a time to live.

    Rows: ms, op, owner, output.
    """

    fields = "result string, reclaimed boolean, replayed string"
    memory = "state string, owner string, output string, expires bigint"
    # operation, record held, asked by the owner, record still valid: verdict
    VERDICTS = {
        ("claim", "in-progress", False, True): "busy",
        ("claim", "succeeded", False, True): "replay",
        ("claim", "succeeded", True, True): "replay",
        ("complete", "in-progress", True, False): "completed",
        ("complete", "in-progress", True, True): "completed",
        ("complete", "succeeded", True, False): "completed",
        ("complete", "succeeded", True, True): "completed",
        ("release", "in-progress", True, False): "released",
        ("release", "in-progress", True, True): "released",
    }
    OTHERWISE = {"claim": "claimed", "complete": "ignored", "release": "ignored"}

    def __init__(self, lease_ms: int = 300_000, ttl_ms: int = 7 * 86_400_000):
        self.lease_ms, self.ttl_ms = lease_ms, ttl_ms
        self.state = self.owner = self.output = self.expires = None

    def step(self, row) -> tuple:
        op = row.op if row.op in ("claim", "complete") else "release"
        valid = self.expires is not None and self.expires > row.ms
        result = self.VERDICTS.get((op, self.state, self.owner == row.owner, valid), self.OTHERWISE[op])
        reclaimed = self.state is not None if result == "claimed" else None
        replayed = self.output if result == "replay" else None
        after = {
            "claimed": ("in-progress", row.owner, None, row.ms + self.lease_ms),
            "completed": ("succeeded", self.owner, row.output, row.ms + self.ttl_ms),
            "released": (None, None, None, None),
        }
        self.state, self.owner, self.output, self.expires = after.get(result, (self.state, self.owner, self.output, self.expires))
        return result, reclaimed, replayed


class RunState:
    """Run row rebuilt from its events.  Rows: ms, seq, type, cost, code."""

    fields = "status string, started_ms bigint, finished_ms bigint, cost double, code string"
    memory = "status string, started bigint, finished bigint, cost double, code string"
    # Status each event leads to
    MOVES = {
        "run.queued": "queued", "run.started": "running", "run.resumed": "running", "run.compensating": "compensating", "run.succeeded": "succeeded",
        "run.failed": "failed", "run.cancelled": "cancelled", "run.rolled-back": "rolled-back", "run.compensation-failed": "compensation-failed",
    }
    FINAL = ("succeeded", "failed", "cancelled", "rolled-back", "compensation-failed")

    def __init__(self):
        self.status = self.started = self.finished = self.code = None
        self.cost = 0.0

    def step(self, row) -> tuple:
        to = self.MOVES.get(row.type)
        if to is not None:
            self.status = to
            if to == "running" and self.started is None:
                self.started = row.ms
            if to in self.FINAL:
                self.finished = row.ms
        self.cost += row.cost if row.cost == row.cost and row.cost is not None else 0.0
        self.code = row.code if isinstance(row.code, str) else self.code
        return self.status, self.started, self.finished, self.cost, self.code


class Lockout:
    """Account lock after n failed logins; success resets.  Rows: ms, ok."""

    fields = "failures int, locked boolean, locked_until_ms bigint"
    memory = "failures int, until bigint"

    def __init__(self, limit: int = 5, lock_ms: int = 900_000):
        self.limit, self.lock_ms, self.failures, self.until = limit, lock_ms, 0, None

    def step(self, row) -> tuple:
        if row.ok:
            self.failures, self.until = 0, None
            return 0, False, None
        self.failures += 1
        if self.failures < self.limit:
            return self.failures, False, self.until
        self.failures, self.until = 0, row.ms + self.lock_ms
        return 0, True, self.until


def _schema(df: DataFrame, fields: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(fields).fields])


def _apply(rule: Any, pdf: pd.DataFrame, names: Sequence[str]) -> pd.DataFrame:
    out = [rule.step(r) for r in pdf.itertuples(index=False)]
    for i, n in enumerate(names):
        pdf[n] = pd.Series([o[i] for o in out], index=pdf.index, dtype="object")
    return pdf


def fold_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], make: Rule, fields: str) -> DataFrame:
    """Every row with the rule's verdict: keys in parallel, rows of a key in order.

    One pass over sorted partitions; a new key starts a new rule, so a million
    short keys cost no more than one long one.
    """
    schema = _schema(df, fields)
    names = [f.name for f in T.StructType.fromDDL(fields).fields]
    keys, order = list(keys), list(order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, rule = None, None
        for pdf in batches:
            out = []
            for row, key in zip(pdf.itertuples(index=False), pdf[keys].itertuples(index=False, name=None)):
                if rule is None or key != current:
                    current, rule = key, make()
                out.append(rule.step(row))
            for i, n in enumerate(names):
                pdf[n] = pd.Series([o[i] for o in out], index=pdf.index, dtype="object")
            yield pdf

    ordered = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return ordered.mapInPandas(run, schema)


_PLAIN = {"string": str, "integer": int, "long": int, "double": float, "boolean": bool}


class _Processor(StatefulProcessor):
    """Runs a rule per key; what the rule remembers is one row of typed columns in the state store."""

    def __init__(self, make: Rule, order: Sequence[str], names: Sequence[str], memory: str, ttl_ms: int | None):
        self.make, self.order, self.names, self.ttl_ms = make, list(order), list(names), ttl_ms
        self.columns = T.StructType.fromDDL(memory)

    def init(self, handle) -> None:
        self.cell = handle.getValueState("rule", self.columns, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rule = self.make()
        if self.cell.exists():
            for column, value in zip(self.columns, self.cell.get()):
                setattr(rule, column.name, value)
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(self.order, ignore_index=True)
        out = _apply(rule, pdf, self.names)
        held = ((c, getattr(rule, c.name)) for c in self.columns)
        self.cell.update(tuple(None if v is None or v != v else _PLAIN[c.dataType.typeName()](v) for c, v in held))
        yield out

    def close(self) -> None:
        pass


def on_stream(df: DataFrame, keys: Sequence[str], order: Sequence[str], make: Rule, fields: str, ttl_ms: int | None = None) -> DataFrame:
    """The same rule over a stream.  State of silent keys expires after ``ttl_ms`` of processing time.

    The state has the columns of the rule's ``memory``, so it can be read with the state data source and
    outlives changes to the rule's code.
    """
    names = [f.name for f in T.StructType.fromDDL(fields).fields]
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Processor(make, order, names, make().memory, ttl_ms), outputStructType=_schema(df, fields), outputMode="append",
        timeMode="processingTime" if ttl_ms else "none")


# ----------------------------------------------------------- rules over history
def dedup_requests(requests: DataFrame, window_ms: int, rows_per_chunk: int = 1_000_000) -> DataFrame:
    """Accepted and joined run requests: tenant_id, workflow_name, dedup_key, seq, ms, cancelled.

    ``seq`` follows time.  Requests that are not cancelled block their key for a window from the one that was
    accepted; these form a chain that is walked by pointer doubling.  Every request then looks back at the last
    blocking one.  A request without a key is always accepted.
    """
    keys = ["tenant_id", "workflow_name", "dedup_key"]
    free, keyed = requests.where("dedup_key IS NULL"), requests.where("dedup_key IS NOT NULL")
    able = keyed.where(~F.coalesce("cancelled", F.lit(False)))
    blocking = spaced_firsts(able, keys, "ms", window_ms)
    able = able.groupBy(*keys, "ms").agg(F.min("seq").alias("owner"))
    blocking = _same_group(blocking, able, [*keys, "ms"]).select(*keys, "owner", F.col("ms").alias("owner_ms"), (-F.col("owner")).alias("_at"))
    looked = first_at_or_after(keyed.withColumn("_back", -F.col("seq")), blocking, keys, "_back", "_at", ["owner", "owner_ms"], bucket_ms=rows_per_chunk)
    joins = (F.col("owner") < F.col("seq")) & (F.col("ms") - F.col("owner_ms") <= window_ms)
    out = looked.withColumn("status", F.when(joins, "deduplicated").otherwise("accepted")).withColumn("joined", F.when(joins, F.col("owner")).otherwise(F.col("seq")))
    free = free.withColumn("status", F.lit("accepted")).withColumn("joined", F.col("seq"))
    return out.select(*requests.columns, "status", "joined").unionByName(free)


def replay_circuits(operations: DataFrame, threshold: int = 5, cooldown_ms: int = 30_000, rows_per_chunk: int = 1_000_000) -> DataFrame:
    """Circuit state after every operation: capability, seq, ms, op; ``seq`` follows time.

    A success closes the circuit whatever came before, so history falls into parts that end with one.  In a part the
    failure that reaches the threshold opens the circuit.  From then on the first check after the cool-down is a probe,
    and the first failure after the probe opens the circuit again, so openings are a chain, walked by pointer doubling;
    all other rows follow from the last opening and its probe.  A capability that never succeeds is spread like any other.
    """
    part, by_time = ["capability", "part"], cooldown_ms > 0
    kind = F.when(F.col("op").isin("check", "success", "failure"), F.col("op")).otherwise("release")
    ended, failed = F.when(F.col("kind") == "success", 1).otherwise(0), F.when(F.col("kind") == "failure", 1).otherwise(0)
    o = chunked_running_sum(operations.withColumn("kind", kind), ["capability"], "seq", ended, "wins", rows_per_chunk)
    o = chunked_running_sum(o.withColumn("part", F.col("wins") - ended).drop("wins"), part, "seq", failed, "fails", rows_per_chunk)
    o = cut_lineage(o, "circuit-operations")

    # the probe that would follow if a failure opened the circuit, and the failure after the probe
    able = o.where((F.col("kind") == "failure") & (F.col("fails") >= threshold)).select(*part, "seq", "ms", "fails")
    due = F.col("ms") + cooldown_ms if by_time else F.col("seq") + 1
    checks = o.where("kind = 'check'").select(*part, F.col("ms" if by_time else "seq").alias("probe_at"), F.col("seq").alias("probe"))
    able = first_at_or_after(able.withColumn("due", due), checks, part, "due", "probe_at", ["probe"], bucket_ms=3_600_000 if by_time else rows_per_chunk)
    able = cut_lineage(able.drop("due", "probe_at"), "circuit-probes")
    jump = first_at_or_after(able.where("probe IS NOT NULL").select(*part, "seq", "probe"), able.select(*part, F.col("seq").alias("_next")), part, "probe", "_next", [], bucket_ms=rows_per_chunk)
    openings = walked(able.where(F.col("fails") == threshold), jump.where("_next IS NOT NULL"), part, "seq")

    # every row with the last opening, its number and its probe, and with the last check or release before the row
    opened = chunked_running_sum(_same_group(able.drop("fails"), openings, [*part, "seq"]), part, "seq", F.lit(1), "nth", rows_per_chunk)
    opening = opened.select(F.col("capability").alias("_c"), F.col("part").alias("_p"), F.col("seq").alias("_s"), F.struct("nth", F.col("ms").alias("at"), "probe").alias("_opening"))
    o = o.join(opening, F.col("capability").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")) & (F.col("seq") == F.col("_s")), "left").drop("_c", "_p", "_s")
    asked = F.when(F.col("kind").isin("check", "release"), F.struct("seq", "kind"))
    o = chunked_running(o, part, "seq", {"opening": F.col("_opening")}, {"before": asked}, rows_per_chunk)
    o = o.select("*", F.coalesce("opening.nth", F.lit(0)).alias("nth"), F.col("opening.at").alias("opened_ms"), F.col("opening.probe").alias("probe"))
    half = F.coalesce(F.col("seq") >= F.col("probe"), F.lit(False))
    closed = (F.col("kind") == "success") | (F.col("nth") == 0)
    let = closed | (half & ((F.col("seq") == F.col("probe")) | (F.col("before.kind") == "release")))
    check = F.col("kind") == "check"
    return o.select(
        *operations.columns,
        F.when(closed, "closed").when(half, "half-open").otherwise("open").alias("state"),
        F.when(F.col("kind") == "success", 0).otherwise(F.col("fails") - F.greatest(F.col("nth") - 1, F.lit(0))).cast("int").alias("failures"),
        F.when(check, let).alias("allowed"),
        F.when(check & ~let, F.when(half, 1000).otherwise(F.col("opened_ms") + cooldown_ms - F.col("ms"))).cast("bigint").alias("retry_after_ms"),
    )


def circuit_snapshot(replayed: DataFrame) -> DataFrame:
    """Latest state of each capability."""
    return replayed.groupBy("capability").agg(F.max_by("state", "seq").alias("state"), F.max_by("failures", "seq").alias("failures"))


def classify_attempts(attempts: DataFrame, lease_ms: int = 300_000, ttl_ms: int = 7 * 86_400_000) -> DataFrame:
    """Ledger verdicts: tenant_id, capability, key, seq, ms, op, owner, output."""
    return fold_sorted(attempts, ["tenant_id", "capability", "key"], ["ms", "seq"], lambda: Ledger(lease_ms, ttl_ms), Ledger.fields)


def run_states(events: DataFrame) -> DataFrame:
    """Current run rows from the whole event log, by plain aggregation: run_id, seq, ms, type, cost, code."""
    moves = F.create_map(*[F.lit(x) for kv in RunState.MOVES.items() for x in kv])
    e = events.withColumn("to", F.try_element_at(moves, F.col("type")))
    final = F.col("to").isin(*RunState.FINAL)
    return e.groupBy("tenant_id", "run_id").agg(
        F.max_by("to", F.when(F.col("to").isNotNull(), F.col("seq"))).alias("status"),
        F.min_by("ms", F.when(F.col("to") == "running", F.col("seq"))).alias("started_ms"),
        F.max_by("ms", F.when(final, F.col("seq"))).alias("finished_ms"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.max_by("code", F.when(F.col("code").isNotNull(), F.col("seq"))).alias("code"),
    )


def lockouts(logins: DataFrame, limit: int = 5, lock_ms: int = 900_000, rows_per_chunk: int = 1_000_000) -> DataFrame:
    """Failed logins in a row and the locks they cause: tenant_id, user_id, seq, ms, ok.

    Failures since the last success decide, so it is a count within a run of failures.
    """
    keys = ["tenant_id", "user_id"]
    wins = F.when(F.col("ok"), 1).otherwise(0)
    r = chunked_running_sum(logins, keys, "seq", wins, "streak", rows_per_chunk)
    r = chunked_running_sum(r, [*keys, "streak"], "seq", 1 - wins, "_n", rows_per_chunk)
    left = F.col("_n") % limit
    locked = ~F.col("ok") & (left == 0)
    return r.withColumn("locked", locked).withColumn("failures", F.when(F.col("ok"), 0).otherwise(left).cast("int")).withColumn(
        "locked_until_ms", F.when(locked, F.col("ms") + lock_ms)).drop("_n", "streak")


def expire_approvals(approvals: DataFrame, as_of) -> DataFrame:
    """What the clock does to pending approvals: escalate once, approve, or time out."""
    late = (F.col("status") == "pending") & (F.col("expires_at") <= as_of)
    up = (F.col("on_timeout") == "escalate") & ~F.col("escalated")
    action = F.when(up, "escalate").when(F.col("on_timeout") == "approve", "approve").otherwise("time-out")
    span = F.col("expires_at") - F.col("requested_at")
    return approvals.where(late).select(
        "tenant_id", "id", action.alias("action"),
        F.when(action == "escalate", "pending").when(action == "approve", "approved").otherwise("timed-out").alias("new_status"),
        F.when(action == "escalate", as_of + span).alias("new_expires_at"),
        F.when(action == "approve", "approved").when(action == "time-out", "denied").alias("outcome"),
    )


PLACES = 2048  # state is kept by place, not by key: a call into Python costs as much as a thousand keys in it


def _placed(df: DataFrame, key: str) -> DataFrame:
    """Adds the place that a key shares with others."""
    return df.withColumn("place", F.pmod(F.xxhash64(key), F.lit(PLACES)).cast("int"))


class _ApprovalTimer(StatefulProcessor):
    """Keeps the pending approvals of a place and wakes up at their deadlines."""

    FIELDS = "tenant_id string, id string, action string, at_ms bigint"
    OPEN = (
        T.StructType().add("id", T.StringType()).add("tenant_id", T.StringType()).add("on_timeout", T.StringType()).add("span", T.LongType())
        .add("escalated", T.BooleanType()).add("due", T.ArrayType(T.LongType()))
    )
    STATE = T.StructType().add("open", T.ArrayType(OPEN)).add("woken", T.LongType())

    def init(self, handle) -> None:
        self.handle = handle
        self.cell = handle.getValueState("approvals", self.STATE)

    def _held(self) -> tuple[dict, int | None]:
        open_, woken = self.cell.get() if self.cell.exists() else ([], None)
        return {r[0]: tuple(r[1:5]) + (list(r[5]),) for r in open_}, woken

    def _hold(self, held: dict, woken: int | None) -> None:
        """Writes what is open, and asks to be woken at the next deadline."""
        if not held:
            self.cell.clear()
            return
        due = min(min(a[4]) for a in held.values())
        if due != woken:
            self.handle.registerTimer(due)
        self.cell.update(([(i, *a) for i, a in held.items()], due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable").drop_duplicates("id", keep="last")
        held, woken = self._held()
        for row in pdf.itertuples(index=False):
            if row.status == "pending":
                due = held[row.id][4] if row.id in held else []
                expires = int(row.expires_ms)
                held[row.id] = (row.tenant_id, row.on_timeout, expires - int(row.requested_ms), bool(row.escalated), due if expires in due else [*due, expires])
            else:
                held.pop(row.id, None)
        if held or woken is not None:
            self._hold(held, woken)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, woken = self._held()
        if woken is None:
            return
        limit = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        out = []
        for i, (tenant, rule, span, escalated, due) in list(held.items()):
            later = [at for at in due if at > limit]
            for at in sorted(at for at in due if at <= limit):
                if rule == "escalate" and not escalated:
                    out.append((tenant, i, "escalate", at))
                    escalated = True
                    later.append(at + span)
                else:
                    out.append((tenant, i, "approve" if rule == "approve" else "time-out", at))
                    later = []
                    break
            if later:
                held[i] = (tenant, rule, span, escalated, later)
            else:
                del held[i]
        self._hold(held, woken)
        if out:
            yield pd.DataFrame(out, columns=["tenant_id", "id", "action", "at_ms"])

    def close(self) -> None:
        pass


def approval_timers(stream: DataFrame, late: str = "1 minute") -> DataFrame:
    """Approval expiry on a stream of approval rows (id, tenant_id, ts, seq, status, on_timeout, escalated, requested_ms, expires_ms)."""
    return _placed(stream.withWatermark("ts", late), "id").groupBy("place").transformWithStateInPandas(
        statefulProcessor=_ApprovalTimer(), outputStructType=T.StructType.fromDDL(_ApprovalTimer.FIELDS), outputMode="append", timeMode="eventTime")


class WaitsProcessor(StatefulProcessor):
    """Open waits of one key, and what the watermark has not passed yet."""

    LATER = (
        T.StructType().add("kind", T.IntegerType()).add("us", T.LongType()).add("wake_us", T.LongType()).add("seq", T.LongType())
        .add("run_id", T.StringType()).add("step_id", T.StringType())
    )
    OPEN = T.StructType().add("us", T.LongType()).add("wake_us", T.LongType()).add("run_id", T.StringType()).add("step_id", T.StringType())
    FIELDS = "tenant_id string, run_id string, step_id string, wait_us bigint, seq bigint, event_us bigint, outcome string"

    def init(self, handle) -> None:
        self.handle = handle
        self.later = handle.getListState("later", self.LATER)
        self.open = handle.getListState("open", self.OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [
            (int(r.kind), int(r.us), None if pd.isna(r.wake_us) else int(r.wake_us), None if pd.isna(r.seq) else int(r.seq), r.run_id, r.step_id)
            for pdf in rows for r in pdf.itertuples(index=False)
        ]
        self.later.appendList(new)
        return self._settle(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._settle(key, timerValues.getCurrentWatermarkInMs())

    def _settle(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        limit = watermark_ms * 1000
        rows = list(self.later.get()) if self.later.exists() else []
        waiting = [tuple(w) for w in self.open.get()] if self.open.exists() else []
        rest = [tuple(r) for r in rows if r[1] >= limit]
        out = []
        for kind, us, wake, seq, run, step in sorted((tuple(r) for r in rows if r[1] < limit), key=lambda r: (r[1], r[0], r[3] or 0)):
            if kind == 0:
                waiting.append((us, wake, run, step))
                continue
            out += [(key[0], w[2], w[3], w[0], seq, us, "resumed") if us <= w[1] else (key[0], w[2], w[3], w[0], None, None, "WAIT_TIMEOUT") for w in waiting]
            waiting = []
        out += [(key[0], w[2], w[3], w[0], None, None, "WAIT_TIMEOUT") for w in waiting if w[1] < limit]
        waiting = [w for w in waiting if w[1] >= limit]
        for state, left in ((self.later, rest), (self.open, waiting)):
            state.put(left) if left else state.clear()
        due = [r[1] for r in rest] + [w[1] for w in waiting]
        if due:
            self.handle.registerTimer(min(due) // 1000 + 1)
        if out:
            frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in self.FIELDS.split(", ")])
            for c in ("seq", "event_us"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    def close(self) -> None:
        pass


def settle_waits(offered: DataFrame, processor: WaitsProcessor) -> DataFrame:
    """Waits and events of a stream (see ``streaming.operators.offers``) through the processor."""
    rows = offered.withColumn("us", F.unix_micros("ts"))
    out = rows.groupBy("tenant_id", "wait_event", "any", "corr").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=T.StructType.fromDDL(WaitsProcessor.FIELDS), outputMode="append", timeMode="eventTime")
    return out.select("tenant_id", "run_id", "step_id", F.timestamp_micros("wait_us").alias("wait_ts"), "seq", F.timestamp_micros("event_us").alias("event_ts"), "outcome")


class OnceProcessor(StatefulProcessor):
    """Lets a row of a key through unless another was within the span before; forgets a key when the watermark has passed its span.

    All keys of a place are looked at together; its state is their texts and the moments of the rows that were let through last.
    """

    STATE = T.StructType().add("keys", T.ArrayType(T.StringType())).add("us", T.ArrayType(T.LongType())).add("woken", T.LongType())

    def __init__(self, span_us: int, order: Sequence[str]):
        self.span_us, self.order = span_us, list(order)

    def init(self, handle) -> None:
        self.handle = handle
        self.cell = handle.getValueState("last", self.STATE)

    def _held(self) -> tuple[dict, int | None]:
        keys, us, woken = self.cell.get() if self.cell.exists() else ([], [], None)
        return dict(zip(keys, us)), woken

    def _hold(self, held: dict, woken: int | None, watermark_us: int) -> None:
        """Writes what is not forgotten, and asks to be woken when the next key is to be."""
        held = {k: us for k, us in held.items() if us + self.span_us >= watermark_us}
        if not held:
            self.cell.clear()
            return
        due = (min(held.values()) + self.span_us) // 1000 + 1
        if due != woken:
            self.handle.registerTimer(due)
        self.cell.update((list(held), list(held.values()), due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(self.order, ignore_index=True)
        held, woken = self._held()
        through = []
        for k, us in zip(pdf["once_key"].tolist(), pdf["once_us"].tolist()):
            last = held.get(k)
            through.append(last is None or us - last > self.span_us)
            if through[-1]:
                held[k] = int(us)
        if any(through):
            self._hold(held, woken, timerValues.getCurrentWatermarkInMs() * 1000)
        yield pdf[pd.Series(through, index=pdf.index)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, woken = self._held()
        if woken is not None:
            self._hold(held, woken, timerValues.getCurrentWatermarkInMs() * 1000)
        return iter([])

    def close(self) -> None:
        pass


def let_through(timed: DataFrame, keys: Sequence[str], order: Sequence[str], span_us: int) -> DataFrame:
    """Rows of a stream with a watermark and ``once_us``, once per key and span."""
    text = F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))
    keyed = _placed(timed.withColumn("once_key", text), "once_key")
    return keyed.groupBy("place").transformWithStateInPandas(
        statefulProcessor=OnceProcessor(span_us, order), outputStructType=keyed.schema, outputMode="append", timeMode="eventTime").drop("once_key", "place")


class NewestProcessor(StatefulProcessor):
    """The newest runs of a workflow as list state, and what they say about each version on trial."""

    RUN = T.StructType().add("us", T.LongType()).add("id", T.StringType()).add("status", T.StringType()).add("canary", T.BooleanType()).add("version", T.StringType())
    FIELDS = "tenant_id string, workflow_name string, trials array<struct<version:string,runs:bigint,failed:bigint>>"

    def __init__(self, newest: int, finished: Sequence[str]):
        self.newest, self.finished = newest, set(finished)

    def init(self, handle) -> None:
        self.runs = handle.getListState("runs", self.RUN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {r[1]: tuple(r) for r in self.runs.get()} if self.runs.exists() else {}
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                old = known.get(r.id)
                if old is None or old[2] not in self.finished:  # a finished run does not go back
                    known[r.id] = (int(r.us), r.id, r.status, bool(r.canary), r.workflow_version)
        kept = sorted(known.values(), key=lambda r: (r[0], r[1]), reverse=True)[: self.newest]
        self.runs.put(kept)
        counts: dict[str, list[int]] = {}
        for _, _, status, canary, version in kept:
            if canary and status in self.finished and version is not None:
                n = counts.setdefault(version, [0, 0])
                n[0] += 1
                n[1] += status != "succeeded"
        trials = [{"version": v, "runs": n, "failed": bad} for v, (n, bad) in sorted(counts.items())]
        yield pd.DataFrame({"tenant_id": [key[0]], "workflow_name": [key[1]], "trials": [trials]})

    def close(self) -> None:
        pass


def newest_trials(runs: DataFrame, newest: int, finished: Sequence[str]) -> DataFrame:
    """Per workflow with news in a micro-batch: finished trial runs among its newest, by version (update mode)."""
    rows = runs.select("tenant_id", "workflow_name", F.unix_micros("created_at").alias("us"), "id", "status", F.coalesce("canary", F.lit(False)).alias("canary"), "workflow_version")
    return rows.groupBy("tenant_id", "workflow_name").transformWithStateInPandas(
        statefulProcessor=NewestProcessor(newest, finished), outputStructType=T.StructType.fromDDL(NewestProcessor.FIELDS), outputMode="update", timeMode="none")
