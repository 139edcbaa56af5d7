"""User code per event type and per realm."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from labtables import schemas as S
from labtables.operators.routing import Rules, route
from labtables.session import scratch_dir
from labtables.streaming.changes import run

Handler = Callable[[DataFrame, int], None]


class Dispatcher:
    """Runs one handler per event type on each micro-batch.

    A handler gets the batch's rows of its type and the batch id.  Registering
    a type again replaces its handler.  A handler that fails is noted and does
    not stop the others.
    """

    def __init__(self, event_types: tuple[str, ...] = S.EVENT_TYPES) -> None:
        self.event_types = event_types
        self.handlers: dict[str, Handler] = {}

    def register_handler(self, event_type: str, handler: Handler) -> None:
        if event_type not in self.event_types:
            raise ValueError(f"{event_type!r} is not a known event type")
        self.handlers[event_type] = handler

    def dispatch(
        self, batch: DataFrame, batch_id: int, type_column: str = "event_type"
    ) -> list[tuple[str, str]]:
        """Hand a batch to the handlers; returns (event type, error) of failures."""
        errors = []
        held = batch.is_cached
        batch = batch.persist()
        try:
            for event_type, handler in list(self.handlers.items()):
                try:
                    handler(batch.where(F.col(type_column) == event_type), batch_id)
                except Exception as error:  # noqa: BLE001 - any user error
                    errors.append((event_type, f"{type(error).__name__}: {error}"))
        finally:
            if not held:
                batch.unpersist()
        return errors

    def without_handler(self, events: DataFrame, type_column: str = "event_type") -> DataFrame:
        """Rows of event types that no handler is registered for."""
        known = F.coalesce(F.col(type_column).isin(*self.handlers), F.lit(False))
        return events.where(~known)

    def unhandled(self, events: DataFrame, type_column: str = "event_type") -> DataFrame:
        """Row counts of event types without a handler."""
        rows = self.without_handler(events, type_column)
        return rows.groupBy(type_column).agg(F.count("*").alias("n_rows"))

    def start(
        self,
        events: DataFrame,
        checkpoint: str,
        errors_path: str,
        type_column: str = "event_type",
        poll_seconds: int | None = None,
        replay_path: str | None = None,
        unhandled_path: str | None = None,
    ) -> StreamingQuery:
        """Dispatch a stream; failures are written to ``errors_path`` per batch.

        ``replay_path`` keeps the rows whose handler failed, as a stream would read
        them again; ``unhandled_path`` keeps those of types without a handler.  Both
        are written per batch, so a retried batch rewrites its own.
        """

        def each_batch(batch: DataFrame, batch_id: int) -> None:
            batch = batch.persist()
            try:
                errors = self.dispatch(batch, batch_id, type_column)
                if unhandled_path is not None:
                    self.without_handler(batch, type_column).write.mode("overwrite").parquet(
                        f"{unhandled_path}/batch={batch_id}"
                    )
                if errors and replay_path is not None:
                    failed = {event_type for event_type, _ in errors}
                    batch.where(F.col(type_column).isin(*failed)).write.mode("overwrite").parquet(
                        f"{replay_path}/batch={batch_id}"
                    )
                if errors:
                    batch.sparkSession.createDataFrame(
                        errors, "event_type STRING, error STRING"
                    ).write.mode("overwrite").parquet(f"{errors_path}/batch={batch_id}")
            finally:
                batch.unpersist()

        return run(events, each_batch, checkpoint, poll_seconds)


@dataclass(frozen=True)
class Realm:
    """User code of one method family: rows in, samples out, and a last step."""

    extract: Callable[[DataFrame], DataFrame]
    finalize: Callable[[DataFrame], DataFrame]


class Realms:
    """Realms by name, and the rules that route documents to them."""

    def __init__(self) -> None:
        self.realms: dict[str, Realm] = {}

    def register_realm(
        self,
        name: str,
        extract: Callable[[DataFrame], DataFrame],
        finalize: Callable[[DataFrame], DataFrame] = lambda df: df,
    ) -> None:
        self.realms[name] = Realm(extract, finalize)

    def without_realm(self, docs: DataFrame, method: str, rules: Rules) -> DataFrame:
        """Side output of :meth:`apply`: how many documents each target without a realm has."""
        routed = route(docs, method, rules, out="realm")
        lost = routed.where(~F.col("realm").isin(*self.realms)) if self.realms else routed
        return lost.groupBy("realm").agg(F.count("*").alias("n_rows"))

    def apply(
        self, docs: DataFrame, method: str, rules: Rules, staging: str | None = None
    ) -> DataFrame:
        """Route documents, run each realm on its own slice, unite the results.

        Rules whose realm is not registered are skipped, so their documents
        drop out (:meth:`without_realm` counts them).  With several realms the
        documents are read and routed once: they are written to ``staging`` (a
        scratch folder by default) by realm, and each realm reads only its own.
        """
        routed = route(docs, method, rules, out="realm")
        if len(self.realms) > 1 or staging is not None:
            staging = staging or scratch_dir(docs.sparkSession, "realms")
            mine = routed.where(F.col("realm").isin(*self.realms))
            mine.write.mode("overwrite").partitionBy("realm").parquet(staging)
            # The schema is given, as names of realms that look like numbers are names all the same.
            routed = docs.sparkSession.read.schema(routed.schema).parquet(staging)
        out = None
        for name, realm in self.realms.items():
            part = (
                routed.where(F.col("realm") == name)
                .transform(realm.extract)
                .transform(realm.finalize)
            )
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError("no realm registered")
        return out
