"""Runs that are taken up again: what is left to do, as keyed state, and a refusal where a run's settings have changed.

A stream of rows (condition, kind, doc_id, config_sha256, inputs_sha256) drives it: `plan` rows say that a document belongs to
a run with those settings and inputs, `done` rows that its output is there. For every condition the first plan's digests
are kept in the state store; a later plan with others stops the query with an error that names the condition and what has
changed, before anything of that batch is handed on. Documents that are planned and not done come out, once for each
plan that names them.

State is keyed by condition and one of SHARDS hashes of the document, so a condition with most rows is not one task; each shard
keeps the digests for itself. Defined results: a done row of a document that was never planned is remembered; null
conditions, kinds or doc_ids are left out; null digests are as empty; within a batch done rows count before plans, and of
plans with unequal digests in one batch, the first by digest is taken for the run's and the next is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SHARDS = 64
SCHEMA = "condition string, kind string, doc_id string, config_sha256 string, inputs_sha256 string"
OUT = "condition string, doc_id string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ChangedRun(ValueError):
    """A condition was taken up again with other settings or inputs."""


class Resume(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "config_sha256 string, inputs_sha256 string")
        self.done = handle.getMapState("done", "doc_id string", "done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        plans = []
        for batch in rows:
            for doc in batch.loc[batch.kind == "done", "doc_id"]:
                self.done.updateValue((doc,), (True,))
            plans.append(batch[batch.kind == "plan"])
        plan = pd.concat(plans).sort_values(["config_sha256", "inputs_sha256", "doc_id"]).drop_duplicates("doc_id")
        first = self.run.get() if self.run.exists() else None
        for config, inputs in plan[["config_sha256", "inputs_sha256"]].drop_duplicates().itertuples(index=False):
            if first is None:
                first = (config, inputs)
                self.run.update(first)
            changed = [n for n, a, b in zip(("config_sha256", "inputs_sha256"), first, (config, inputs), strict=True) if a != b]
            if changed:
                raise ChangedRun(f"run {key[0]!r} was begun with other settings: {', '.join(changed)} changed")
        todo = [d for d in plan.doc_id if not self.done.containsKey((d,))]
        yield pd.DataFrame({"condition": [key[0]] * len(todo), "doc_id": todo}, dtype=object)

    def close(self) -> None:
        pass


def left_to_do(events: DataFrame) -> DataFrame:
    """A streaming table (condition, doc_id) of what each plan leaves to do; raises ChangedRun within the query."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    own = events.where("condition is not null and kind is not null and doc_id is not null").select(
        "condition", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).alias("shard"), "kind", "doc_id",
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("config_sha256", "inputs_sha256")),
    )
    return own.groupBy("condition", "shard").transformWithStateInPandas(
        statefulProcessor=Resume(), outputStructType=OUT, outputMode="Append", timeMode="None"
    )
