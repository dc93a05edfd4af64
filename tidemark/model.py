"""Table schemas, status sets and the other fixed values of the data model.

Nothing is ever inferred from data: readers take these schemas.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Status domains
TERMINAL_RUN = ("succeeded", "failed", "rolled-back", "compensation-failed", "cancelled")
ACTIVE_RUN = ("running", "waiting-approval", "waiting-event", "compensating")
RUN_STATUSES = ("queued",) + ACTIVE_RUN + TERMINAL_RUN
FAILED_RUN = ("failed", "rolled-back", "compensation-failed")
FINISHED_RUN = ("succeeded",) + FAILED_RUN
TERMINAL_STEP = ("succeeded", "failed", "skipped", "cancelled")
SEEN_STEP = ("succeeded", "failed", "skipped")
LIVE_STEP = ("running", "retry-wait", "waiting-approval", "waiting-event", "waiting-timer", "waiting-child")
SENSITIVITY = ("public", "internal", "confidential", "secret")
SEVERITY_ORDER = {"high": 0, "medium": 1, "low": 2, "info": 3}
RISK_ORDER = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}

# Legal moves of the run state machine
RUN_TRANSITIONS = {
    "queued": ("running", "cancelled"),
    "running": ("waiting-approval", "waiting-event", "compensating", "succeeded", "failed", "cancelled"),
    "waiting-approval": ("running", "failed", "cancelled", "compensating"),
    "waiting-event": ("running", "failed", "cancelled", "compensating"),
    "compensating": ("rolled-back", "compensation-failed"),
}

# Event types, "needs a run id", required data keys
EVENT_CATALOGUE = {
    "run.queued": (True, ["workflow", "version", "planHash"]),
    "run.started": (True, []),
    "run.succeeded": (True, []),
    "run.failed": (True, ["error"]),
    "run.cancelled": (True, []),
    "run.waiting": (True, ["on"]),
    "run.resumed": (True, []),
    "run.compensating": (True, ["cause"]),
    "run.rolled-back": (True, []),
    "run.compensation-failed": (True, ["error"]),
    "run.deduplicated": (False, ["workflow", "existingRunId"]),
    "run.skipped": (False, ["workflow", "reason"]),
    "run.guard-failed": (True, ["guard"]),
    "run.recovered": (True, []),
    "step.started": (True, ["attempt"]),
    "step.succeeded": (True, ["attempt", "durationMs"]),
    "step.failed": (True, ["attempt", "error"]),
    "step.retry-scheduled": (True, ["attempt", "delayMs"]),
    "step.skipped": (True, ["reason"]),
    "step.waiting": (True, ["on"]),
    "step.idempotent-replay": (True, ["idempotencyKey"]),
    "step.recovered": (True, []),
    "step.dry-run": (True, []),
    "step.item.succeeded": (True, ["index"]),
    "step.item.failed": (True, ["index", "error"]),
    "step.compensation.started": (True, []),
    "step.compensation.succeeded": (True, []),
    "step.compensation.failed": (True, ["error"]),
    "approval.requested": (True, ["approvalId"]),
    "approval.decided": (True, ["approvalId", "decision"]),
    "approval.timed-out": (True, ["approvalId", "outcome"]),
    "approval.escalated": (True, ["approvalId"]),
    "secret.lease.issued": (False, ["leaseId", "names"]),
    "secret.lease.revoked": (False, ["leaseId"]),
    "secret.written": (False, ["name"]),
    "secret.deleted": (False, ["name"]),
    "policy.decision": (False, ["action", "effect", "reasonCode"]),
    "workflow.draft-saved": (False, ["workflow"]),
    "workflow.change-requested": (False, ["workflow", "version", "changeId"]),
    "workflow.change-approved": (False, ["workflow", "version", "changeId"]),
    "workflow.change-rejected": (False, ["workflow", "version", "changeId"]),
    "workflow.published": (False, ["workflow", "version", "planHash"]),
    "workflow.deprecated": (False, ["workflow", "version"]),
    "workflow.killed": (False, ["workflow"]),
    "workflow.revived": (False, ["workflow"]),
    "workflow.settings-changed": (False, ["workflow"]),
    "workflow.rollout-changed": (False, ["workflow"]),
    "trigger.registered": (False, ["workflow", "trigger"]),
    "trigger.fired": (False, ["workflow", "trigger"]),
    "trigger.rejected": (False, ["workflow", "trigger", "reason"]),
    "auth.login": (False, []),
    "auth.login-failed": (False, []),
    "auth.logout": (False, []),
    "auth.user-created": (False, ["userId"]),
    "auth.user-updated": (False, ["userId"]),
    "auth.account-deleted": (False, ["userId"]),
    "auth.apikey-created": (False, ["keyId"]),
    "auth.apikey-revoked": (False, ["keyId"]),
    "capability.killed": (False, ["capability"]),
    "capability.revived": (False, ["capability"]),
    "capability.circuit-opened": (False, ["capability"]),
    "capability.circuit-closed": (False, ["capability"]),
    "agent.draft-created": (False, ["agent", "draftId"]),
    "agent.proposal-created": (False, ["agent", "proposalId"]),
    "authoring.autonomy-applied": (False, ["draftId", "tier", "mode"]),
    "pentest.finding": (False, ["ruleId", "severity"]),
    "insight.analysis-completed": (False, ["findings", "proposals"]),
    "alert.raised": (False, ["key", "severity", "title"]),
    "alert.resolved": (False, ["key"]),
    "system.started": (False, []),
    "system.stopped": (False, []),
    "audit.export": (False, []),
    "artifact.tombstoned": (False, ["ref"]),
}
MAX_EVENT_DATA_BYTES = 65536
GENESIS_HASH = "sha256:" + "0" * 64

# Monthly run limits of the plan ladder
PLAN_LIMITS = {"free": 25, "pro": 500, "team": 2500}
PAID_PLANS = ("pro", "team")

# Histogram bounds in seconds
DURATION_BUCKETS = (0.005, 0.025, 0.1, 0.5, 1.0, 2.5, 10.0, 30.0, 120.0, 600.0, 3600.0)

USAGE_EVENTS = ("run.succeeded", "run.failed", "run.cancelled", "run.rolled-back", "run.compensation-failed")
AUDIT_EVENTS = (
    "workflow.published",
    "workflow.killed",
    "workflow.revived",
    "workflow.deprecated",
    "workflow.change-approved",
    "workflow.change-rejected",
    "approval.decided",
)

_ERROR = "struct<code:string,message:string,class:string,retryable:boolean>"

# Column lists of the history tables, as DDL.
TABLE_DDL = {
    "tenants": "id string, name string, created_at timestamp, disabled boolean",
    "users": "id string, tenant_id string, email string, name string, roles array<string>, disabled boolean, "
    "created_at timestamp, last_login_at timestamp, failed_logins int, locked_until timestamp, "
    "email_unverified boolean",
    "events": "seq bigint, id string, tenant_id string, ts timestamp, type string, run_id string, step_id string, "
    "attempt int, actor struct<type:string,id:string,name:string>, correlation_id string, data string, "
    "prev_hash string, hash string",
    "runs": "id string, tenant_id string, workflow_name string, workflow_version string, plan_hash string, "
    "status string, dry_run boolean, environment string, trigger_type string, trigger_name string, "
    "trigger_payload string, correlation_id string, parent_run_id string, parent_step_id string, inputs string, "
    "seed string, context_now timestamp, priority int, dedup_key string, requested_by string, canary boolean, "
    f"created_at timestamp, started_at timestamp, finished_at timestamp, error {_ERROR}, outputs string, "
    "cost double, cancel_requested boolean",
    "step_states": "run_id string, step_id string, status string, attempt int, started_at timestamp, "
    f"finished_at timestamp, wake_at timestamp, output string, output_ref string, error {_ERROR}, "
    "skipped_reason string, handled string, idempotency_key string, child_run_id string, approval_id string, "
    "wait_event string, wait_correlation string, compensation_status string, "
    f"compensation_error {_ERROR}, completed_seq bigint, cost double, updated_at timestamp",
    "approvals": "id string, tenant_id string, run_id string, step_id string, status string, message string, "
    "approvers struct<roles:array<string>,users:array<string>>, requested_by string, requested_at timestamp, "
    "expires_at timestamp, on_timeout string, escalated boolean, allow_self boolean, decided_by string, "
    "decided_at timestamp, comment string, workflow_name string",
    "cost_ledger": "tenant_id string, workflow_name string, day date, cost double",
    "workflow_versions": "tenant_id string, name string, version string, status string, manifest_text string, "
    "manifest_hash string, plan_hash string, environment string, parent_version string, published_by string, "
    "published_at timestamp",
    "workflow_settings": "tenant_id string, name string, enabled boolean, killed boolean, autonomy_tier string, "
    "stable_version string, canary_version string, canary_percent int",
    "plan_steps": "tenant_id string, plan_hash string, workflow string, step_id string, type string, `order` int, "
    "family string, capability string, effect string, sensitivity string, retry_attempts int, "
    "retry_on array<string>, with map<string,string>, egress array<string>, scopes array<string>, units double, "
    "max_items int, sunset date, has_compensation boolean, on_timeout string, allow_self boolean",
    "plan_edges": "tenant_id string, plan_hash string, step_id string, depends_on string",
    "triggers": "id string, tenant_id string, workflow_name string, workflow_version string, name string, "
    "type string, config string, enabled boolean, created_at timestamp, last_fired_at timestamp, "
    "next_fire_at timestamp",
    "trigger_fires": "trigger_id string, fire_key string, run_id string, fired_at timestamp",
    "proposals": "id string, tenant_id string, kind string, workflow_name string, title string, body string, "
    "source string, status string, created_at timestamp, decided_by string, decided_at timestamp, "
    "dedupe_key string",
    "findings": "tenant_id string, workflow_name string, version string, rule string, severity string, "
    "step_id string, message string, created_at timestamp",
    "idempotency": "tenant_id string, capability string, key string, state string, owner string, output string, "
    "created_at timestamp, updated_at timestamp, expires_at timestamp",
    "artifacts": "tenant_id string, hash string, size bigint, content_type string, run_id string, "
    "created_at timestamp, tombstoned_at timestamp, tombstone_reason string",
    "outbox": "id string, tenant_id string, org_id string, kind string, name string, payload string, "
    "idempotency_key string, correlation_id string, occurred_at timestamp, attempts int, "
    "next_attempt_at timestamp, sent_at timestamp",
    "webhook_deliveries": "id string, tenant_id string, hook_id string, event_seq bigint, event_type string, "
    "run_id string, payload string, status string, attempts int, next_attempt_at timestamp, "
    "created_at timestamp, delivered_at timestamp",
    "billing_accounts": "tenant_id string, plan string, status string, current_period_end timestamp",
}


def schema_of(table: str) -> T.StructType:
    """The declared schema of one history table."""
    return T.StructType.fromDDL(TABLE_DDL[table])
