"""What the language model does when one of its files is lost."""

import os

import pytest

from dossier.llm import lm_score


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["the cat sat on the mat and the dog sat on the cat " * 3, "a dog and a cat sat on a mat", "the mat"] * 4
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").cache()


@pytest.mark.parametrize("level", ["words", "pairs", "triples"])
def test_a_lost_file_stops_the_scoring(spark, docs, level, monkeypatch):
    made = []
    train = lm_score.train
    monkeypatch.setattr(lm_score, "train", lambda df: made.append(train(df)) or made[-1])
    frame = lm_score.score(docs)
    before = sorted(map(tuple, frame.collect()))
    assert before == sorted(map(tuple, frame.collect())) and len(before) == docs.count()
    folder = getattr(made[0], level).folder
    files = [f for f in os.listdir(folder) if f.isdigit()]
    assert files and all(getattr(made[0], level).has(int(f)) for f in files)
    os.remove(f"{folder}/{files[0]}")
    with pytest.raises(Exception, match=f"No such file.*{level}/{files[0]}"):
        frame.collect()


def test_a_folder_that_is_not_mounted_is_refused(spark, docs, monkeypatch):
    monkeypatch.setattr(lm_score, "shared_dir", lambda _: "hdfs://host/shared")
    with pytest.raises(ValueError, match="must be a mounted folder"):
        lm_score.train(docs)
