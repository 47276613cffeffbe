"""Audit: one JSON line for each job, appended by the driver. Neither secrets nor cell values are recorded."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from maskwright.operators.runner import Outcome, Request, execute
from maskwright.plans.policy import Policy, load_yaml
from maskwright.plans.report import VERSION


def policy_hash(policy: str | dict | Policy) -> str:
    """SHA-256 of the policy without its key block."""
    given = policy.source if isinstance(policy, Policy) else load_yaml(policy) if isinstance(policy, str) else policy
    return hashlib.sha256(json.dumps({k: v for k, v in given.items() if k != "key"}, sort_keys=True, default=str).encode()).hexdigest()


def record(request: Request, outcome: Outcome, limits: dict | None = None) -> dict:
    report = outcome.report or {}
    try:
        digest = policy_hash(request.policy)
    except Exception:  # noqa: BLE001  an unreadable policy is the outcome's error, and is recorded as such
        digest = None
    return {
        "timestamp": datetime.now(UTC).isoformat(timespec="seconds"),
        "version": VERSION,
        "job": request.job,
        "mode": request.mode,
        "engine": "spark",
        "dataset": report.get("dataset"),
        "policy_hash": digest,
        "input": request.input,
        "output": request.output,
        "report": request.report,
        "vault": request.vault,
        "status": outcome.status,
        "rows_read": report.get("rows_read"),
        "rows_written": report.get("rows_written"),
        "warnings": len(report.get("warnings", [])),
        "error": outcome.error,
        "limits": limits or {},
        "provenance": "engine-attested",
    }


def audited(path: str, run: Callable = execute, limits: dict | None = None) -> Callable:
    """``run`` that appends a record of each job to the file at path."""

    def both(spark: SparkSession, request: Request) -> Outcome:
        outcome = run(spark, request)
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps(record(request, outcome, limits), ensure_ascii=False) + "\n")
        return outcome

    return both
