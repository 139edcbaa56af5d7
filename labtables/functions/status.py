"""Predicates and decisions over status columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labtables import schemas as S
from labtables.functions._cols import ColumnOrName, as_col, case_lookup, null_to_blank


def not_aborted(manual_status: ColumnOrName) -> Column:
    """Keep samples whose manual status is missing or anything but aborted."""
    return F.lower(null_to_blank(manual_status)) != "aborted"


def processable(status: ColumnOrName) -> Column:
    return ~null_to_blank(status).isin(*S.NOT_PROCESSABLE)


def good_barcode(barcode: ColumnOrName, bad: str = "bad") -> Column:
    return ~as_col(barcode).cast("string").eqNullSafe(F.lit(bad))


def to_monitor(job_id: ColumnOrName, status: ColumnOrName) -> Column:
    """A job id is known and the status says the job is under way."""
    return (null_to_blank(job_id) != "") & as_col(status).isin(*S.MONITORED)


def post_process_bucket(status: ColumnOrName) -> Column:
    """processed (to do), failed, done, or leftover."""
    return case_lookup(
        status,
        {"processed": "processed", "post_processing_failed": "failed", "completed": "done"},
        F.lit("leftover"),
    )


def to_deliver(qc: ColumnOrName, delivered: ColumnOrName) -> Column:
    return passed_qc(qc) & ~F.coalesce(as_col(delivered), F.lit(False))


def passed_qc(qc: ColumnOrName) -> Column:
    return null_to_blank(qc) == "Passed"


def job_status(state: ColumnOrName) -> Column:
    """Sample status after a scheduler state; null while the job is still on."""
    state = as_col(state)
    return F.when(state == S.JOB_SUCCESS_STATE, F.lit("processed")).when(
        state.isin(*S.JOB_END_STATES), F.lit("processing_failed")
    )


def auto_submit(
    user_manual: ColumnOrName, doc_auto: ColumnOrName, realm_auto: ColumnOrName
) -> Column:
    """Submit unless the user, the document or the realm says otherwise.

    A null user flag is no override, a null document flag means yes and a null
    realm flag means no.
    """
    return (
        ~F.coalesce(as_col(user_manual), F.lit(False))
        & F.coalesce(as_col(doc_auto), F.lit(True))
        & F.coalesce(as_col(realm_auto), F.lit(False))
    )


def project_flow(status: ColumnOrName) -> Column:
    """What to do with a project in a given status."""
    return case_lookup(
        null_to_blank(status),
        {
            "": "main",
            "pending": "main",
            "partially_completed": "main",
            "manually_submitted_samples": "monitor",
            "completed": "none",
        },
        F.lit("skip"),
    )


def rollup_status(
    any_active: ColumnOrName,
    all_finished: ColumnOrName,
    all_not_started: ColumnOrName,
    finished_as: str = "completed",
) -> Column:
    """Project status from its samples' flags, first rule that holds.

    ``finished_as='completed'`` is the documented rule; ``'processing'`` is how
    the original behaves.  A project without samples has all samples finished.
    """
    return (
        F.when(F.coalesce(as_col(any_active), F.lit(False)), F.lit("processing"))
        .when(F.coalesce(as_col(all_finished), F.lit(True)), F.lit(finished_as))
        .when(as_col(all_not_started), F.lit("pending"))
        .otherwise(F.lit("partially_completed"))
    )


# Names of the delivery decisions, in the order the rules are tried.
DELIVERY_ACTIONS = (
    "none",
    "proceed_delivery",
    "wait_for_signing",
    "generate_report",
    "finish_no_passed_samples",
    "finish_all_samples_aborted",
    "finish_some_samples_failed",
)


def delivery_action(
    any_pending: ColumnOrName,
    any_passed: ColumnOrName,
    all_passed_or_aborted: ColumnOrName,
    all_aborted: ColumnOrName,
    has_report: ColumnOrName,
    signee: ColumnOrName,
    rejected: ColumnOrName,
    partial_allowed: ColumnOrName,
    labels: dict[str, str] | None = None,
) -> Column:
    """The next delivery step of a project.

    A report without signee, or one that was rejected, waits.  ``labels``
    renames the actions for a downstream executor.
    """
    names = {name: F.lit((labels or {}).get(name, name)) for name in DELIVERY_ACTIONS}

    def flag(value: ColumnOrName, empty: bool) -> Column:
        return F.coalesce(as_col(value), F.lit(empty))

    signed = (null_to_blank(signee) != "") & as_col(rejected).eqNullSafe(F.lit(False))
    passed = flag(any_passed, False)
    return (
        F.when(flag(any_pending, False), names["none"])
        .when(flag(has_report, False) & signed, names["proceed_delivery"])
        .when(flag(has_report, False), names["wait_for_signing"])
        .when(flag(partial_allowed, False) & passed, names["generate_report"])
        .when(flag(partial_allowed, False), names["finish_no_passed_samples"])
        .when(flag(all_passed_or_aborted, True) & passed, names["generate_report"])
        .when(flag(all_aborted, True), names["finish_all_samples_aborted"])
        .otherwise(names["finish_some_samples_failed"])
    )
