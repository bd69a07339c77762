"""Runs taken up again: what is left, restarts from a checkpoint, and the refusal of changed digests."""

import json
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException

from dossier.streaming import resume


class Run:
    """A folder of events and the stream over it; each `go` is a process that starts anew from the checkpoint."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n, self.had = spark, path, 0, Counter()

    def go(self, *events):
        (self.path / "in").mkdir(exist_ok=True)
        names = ("condition", "kind", "doc_id", "config_sha256", "inputs_sha256")
        lines = [json.dumps(dict(zip(names, e, strict=False))) for e in events]
        (self.path / "in" / f"{self.n}.json").write_text("\n".join(lines))
        self.n += 1
        out = str(self.path / "out")
        stream = self.spark.readStream.schema(resume.SCHEMA).json(str(self.path / "in"))
        query = resume.left_to_do(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(self.path / "cp"))
        query.trigger(availableNow=True).start().awaitTermination()
        had, self.had = self.had, Counter((r.condition, r.doc_id) for r in self.spark.read.schema(resume.OUT).parquet(out).collect())
        return sorted((self.had - had).elements())


def plan(condition, docs, config="c1", inputs="i1"):
    return [(condition, "plan", d, config, inputs) for d in docs]


def test_what_is_left_and_what_is_refused(spark, tmp_path):
    run = Run(spark, tmp_path)
    assert run.go(*plan("zero_shot", "abc")) == [("zero_shot", d) for d in "abc"]
    assert run.go(("zero_shot", "done", "a"), ("zero_shot", "done", "x"), (None, "plan", "q"), ("zero_shot", None, "b")) == []
    assert run.go(*plan("zero_shot", "abcx"), *plan("tuned", "ab", "c9")) == [("tuned", "a"), ("tuned", "b"), ("zero_shot", "b"), ("zero_shot", "c")]
    with pytest.raises(StreamingQueryException, match="run 'zero_shot' was begun with other settings: inputs_sha256 changed"):
        run.go(*plan("zero_shot", "abc", inputs="i2"))


def test_two_digests_in_one_batch(spark, tmp_path):
    with pytest.raises(StreamingQueryException, match="config_sha256 changed"):
        Run(spark, tmp_path).go(*plan("r", [str(k) for k in range(200)]), *plan("r", [str(k) for k in range(200, 400)], config="c2"))
