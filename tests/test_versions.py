import json
import threading

import pytest
from pyspark.sql import functions as F

from labelmill.operators import scoring
from labelmill.sinks import versions, writers
from labelmill.sources import readers

SCHEMA = "k long, v string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_append_once(frame, tmp_path):
    path = str(tmp_path / "log")
    first = frame([(1, "a"), (2, "b"), (2, "b"), (None, "n")], SCHEMA)
    assert versions.append(first, path, ["k"]) == 1
    assert versions.append(first.where("k is not null"), path, ["k"]) is None
    assert versions.append(frame([(2, "other"), (3, "c")], SCHEMA), path, ["k"]) == 2
    assert rows(versions.read_versions(first, path)) == rows(frame([(1, "a"), (2, "b"), (None, "n"), (3, "c")], SCHEMA))
    assert rows(versions.read_versions(first, path, [2])) == [(3, "c")]
    assert not [p for p in (tmp_path / "log").iterdir() if p.name.startswith("_staged")]


def test_competing_writers(spark, frame, tmp_path):
    path = str(tmp_path / "log")
    parts = [frame([(k, f"{w}") for k in range(w, w + 6)], SCHEMA) for w in range(4)]
    threads = [threading.Thread(target=versions.append, args=(df, path, ["k"])) for df in parts]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    held = rows(versions.read_versions(parts[0], path))
    assert sorted(k for k, _ in held) == list(range(9))


def test_failed_attempt_leaves_the_table(spark, frame, tmp_path):
    path = str(tmp_path / "log")
    versions.append(frame([(1, "a")], SCHEMA), path, ["k"])
    broken = frame([(2, "b")], SCHEMA).withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        versions.append(broken, path, ["k"])
    assert rows(versions.read_versions(broken, path)) == [(1, "a")]
    assert versions.append(frame([(2, "b")], SCHEMA), path, ["k"]) == 2


def make_scorer(seen, fail_on=None):
    def factory():
        def score(asked):
            if fail_on and any(fail_on in prompt for prompt in asked):
                raise ValueError("lost")
            with open(seen, "a") as out:
                out.write("".join(f"{prompt}\n" for prompt in asked))
            return [prompt.upper() for prompt in asked]

        return score

    return factory


def test_log_goes_on_where_it_stopped(spark, tmp_path):
    log, seen = str(tmp_path / "log"), str(tmp_path / "seen")
    posts = spark.range(50).select(F.col("id").alias("row_id"), F.when(F.col("id") != 7, F.concat(F.lit("p"), "id", F.lit("."))).alias("prompt"))
    with pytest.raises(Exception, match="lost"):
        scoring.score_with_log(posts, log, {"prompt": "raw"}, make_scorer(seen, "p33."), commit_rows=10, batch_size=4)
    assert versions.versions(spark, log) == [1, 2, 3]
    before = open(seen).read().split()
    assert {f"p{i}." for i in range(30) if i != 7} <= set(before)
    out = scoring.score_with_log(posts, log, {"prompt": "raw"}, make_scorer(seen), commit_rows=10, batch_size=4)
    assert rows(out) == rows(posts.select("row_id", F.upper("prompt").alias("raw")))
    again = open(seen).read().split()[len(before):]
    assert not {f"p{i}." for i in range(30)} & set(again)
    asked = open(seen).read()
    assert rows(scoring.score_with_log(posts, log, {"prompt": "raw"}, make_scorer(seen), commit_rows=10)) == rows(out)
    assert open(seen).read() == asked
    assert scoring.score_with_log(posts.where("row_id < 3"), log, {"prompt": "raw"}, make_scorer(seen)).count() == 3


def test_batches_of_similar_length(spark, tmp_path):
    posts = spark.range(64).select(F.col("id").alias("row_id"), F.repeat(F.lit("x"), F.when(F.col("id") % 2 == 0, 1).otherwise(500)).alias("prompt")).coalesce(1)
    out = tmp_path / "sizes"

    def factory():
        def score(asked):
            with open(out, "a") as file:
                file.write(f"{min(map(len, asked))} {max(map(len, asked))}\n")
            return asked

        return score

    scoring.score_with_log(posts, str(tmp_path / "log"), {"prompt": "raw"}, factory, batch_size=4)
    mixed = [line for line in out.read_text().splitlines() if len(set(line.split())) > 1]
    assert len(mixed) <= 1


def test_json_array_file(spark, tmp_path):
    df = spark.range(300).select((299 - F.col("id")).alias("row"), F.when(F.col("id") % 5 > 0, F.concat(F.lit('a "b" ]}, é\n'), "id")).alias("text"), F.array("id").alias("ids")).repartition(7)
    path = str(tmp_path / "rows.json")
    writers.write_json_array(df, path, ["row"])
    found = json.loads((tmp_path / "rows.json").read_text(encoding="utf-8"))
    assert [r["row"] for r in found] == list(range(300)) and found[4]["text"] is None
    schema = "row long, text string, ids array<long>"
    for ranges in (False, True):
        back = readers.read_json_array(spark, path, schema, ranges=ranges)
        assert back.where("row <> row_id").isEmpty()
        assert rows(back.drop("row_id")) == rows(df)
    with pytest.raises(FileExistsError):
        writers.write_json_array(df, path, ["row"])
    writers.write_json_array(df.limit(0), str(tmp_path / "none.json"), ["row"])
    assert json.loads((tmp_path / "none.json").read_text()) == []
    with pytest.raises(Exception, match="broken"):
        writers.write_json_array(df.withColumn("text", F.raise_error(F.lit("broken")).cast("string")), str(tmp_path / "bad.json"), ["row"])
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["none.json", "rows.json"]
