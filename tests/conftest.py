import datetime as dt

import pytest

from tidemark.session import local_session

NOW = dt.datetime(2026, 6, 1)


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", "8", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


ERR = "struct<code:string,message:string,class:string,retryable:boolean>"
RUN_DDL = (
    "id string, tenant_id string, workflow_name string, workflow_version string, status string, dry_run boolean, canary boolean, trigger_type string, "
    f"trigger_payload string, parent_run_id string, priority int, cost double, created_at timestamp, started_at timestamp, finished_at timestamp, error {ERR}"
)
STEP_DDL = (
    f"run_id string, step_id string, status string, attempt int, cost double, handled string, error {ERR}, compensation_status string, "
    "completed_seq bigint, updated_at timestamp"
)


def ok(**kw):
    return {"status": "succeeded", "attempt": 1, **kw}


def bad(code="HTTP_500", cls="transient", **kw):
    return {"status": "failed", "attempt": 1, "error": (code, f"{code} happened", cls, False), **kw}


def skipped():
    return {"status": "skipped", "attempt": 0}


class Hist:
    """Builds small histories under a hand-moved clock."""

    def __init__(self):
        self.now, self.runs, self.steps, self.plans, self.approvals = NOW, [], [], [], []
        self.settings, self.schedules = [], []

    def advance(self, **kw):
        self.now += dt.timedelta(**kw)

    def publish(self, name, steps, schedule=False, active_since=None):
        """steps: list of (step id, overrides)."""
        for i, (sid, kw) in enumerate(steps):
            row = {"type": "capability", "family": "util", "capability": "util-echo", "with": {"value": "1"}, "retry_on": ["transient"], "sunset": None, "has_compensation": False, **kw}
            self.plans.append(("default", f"h-{name}", name, sid, row["type"], i, row["family"], row["capability"], row["with"], row["retry_on"], row["sunset"], row["has_compensation"]))
        self.settings.append(("default", name, True, False, "1.0.0", active_since or self.now))
        if schedule:
            self.schedules.append(("default", name))

    def run(self, workflow, steps, status="succeeded", cost=0.0, queue_ms=0, duration_ms=1000, dry=False, trigger="manual", scheduled=None, error=None, canary=False, tenant="default"):
        rid = f"run-{len(self.runs):06d}"
        created = self.now
        started = finished = None
        if status != "queued":
            self.advance(milliseconds=queue_ms)
            started = self.now
            if status != "running":
                self.advance(milliseconds=duration_ms)
                finished = self.now
        payload = None if scheduled is None else '{"scheduledFor":"%s"}' % scheduled.strftime("%Y-%m-%dT%H:%M:%S.000Z")
        err = error or (("BOOM", "boom", "systemic", False) if status == "failed" else None)
        self.runs.append((rid, tenant, workflow, "2.0.0" if canary else "1.0.0", status, dry, canary, trigger, payload, None, 0, cost, created, started, finished, err))
        for sid, s in steps.items():
            self.steps.append((rid, sid, s["status"], s.get("attempt", 0), s.get("cost", 0.0), s.get("handled"), s.get("error"), s.get("compensation_status"), s.get("completed_seq"), self.now))
        return rid

    def approve(self, run_id, workflow, step, status, minutes=2):
        asked = self.now
        self.advance(minutes=minutes)
        decided = None if status == "pending" else self.now
        self.approvals.append((f"apr-{len(self.approvals)}", "default", run_id, step, status, asked, asked + dt.timedelta(hours=1), "deny", False, decided, workflow))

    def frames(self, spark):
        f = spark.createDataFrame
        return {
            "runs": f(self.runs, RUN_DDL),
            "steps": f(self.steps, STEP_DDL),
            "approvals": f(self.approvals, "id string, tenant_id string, run_id string, step_id string, status string, requested_at timestamp, expires_at timestamp, on_timeout string, escalated boolean, decided_at timestamp, workflow_name string"),
            "plan_steps": f(self.plans, "tenant_id string, plan_hash string, workflow string, step_id string, type string, `order` int, family string, capability string, with map<string,string>, retry_on array<string>, sunset date, has_compensation boolean"),
            "settings": f([(a, b, c, d, e) for a, b, c, d, e, _ in self.settings], "tenant_id string, name string, enabled boolean, killed boolean, stable_version string"),
            "versions": f([(a, b, e, f"h-{b}", t) for a, b, _, _, e, t in self.settings], "tenant_id string, name string, version string, plan_hash string, published_at timestamp"),
            "schedules": f(self.schedules, "tenant_id string, workflow_name string"),
        }


@pytest.fixture
def hist():
    return Hist()
