"""Files read in ranges against the reader that takes a file as a whole, at every place where ranges and cells may end."""

import json
import random

import pytest
from pyspark.sql import functions as F

from labelmill.batches import BATCH_BYTES
from labelmill.sources import ranges, readers

FIELDS = ['plain', 'a "quoted" word', 'two\nlines', '\n\n"\n', '', 'comma, and "', '""', '"', ' spaced ', 'é ü 漢', 'x' * 40, '\n,"\n', "None"]


def csv_text(rows, line="\n"):
    def field(value):
        return '"' + value.replace('"', '""') + '"' if any(c in value for c in '",\n\r') or value.startswith(" ") else value

    return line.join(",".join(map(field, r)) for r in [("text", "label"), *rows]) + line


@pytest.fixture
def cut(spark, monkeypatch):
    """Ranges of a few bytes and cells of a few lines, for the scan of the file only."""
    scan = ranges._cells

    def set_to(part, cell):
        def cells(*args):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(part))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            try:
                return scan(*args)
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
                spark.conf.unset("spark.sql.files.openCostInBytes")

        monkeypatch.setattr(ranges, "CELL_BYTES", cell)
        monkeypatch.setattr(ranges, "_cells", cells)

    return set_to


def rows_of(df):
    return sorted(map(tuple, df.select("row_id", *[c for c in df.columns if c != "row_id"]).collect()), key=lambda r: r[0])


def test_few_cells_in_a_batch(spark, tmp_path):
    path = tmp_path / "posts.csv"
    path.write_text(csv_text([("x" * 10_000, str(i)) for i in range(2000)]), encoding="utf-8", newline="")
    kept = ranges._cells(spark, str(path), b"\n", lambda data: (0,), "_n int").coalesce(1)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["size", "n"])

    seen = kept.mapInArrow(sizes, "size long, n long").agg(F.max("size"), F.sum("n")).first()
    assert seen[0] <= BATCH_BYTES + 2 * ranges.CELL_BYTES and seen[1] >= 19


@pytest.mark.parametrize("seed", range(2))
def test_csv_at_every_cut(spark, cut, tmp_path, seed):
    draw = random.Random(seed)
    rows = [(draw.choice(FIELDS), draw.choice(FIELDS) or "y") for _ in range(40)]
    path = tmp_path / "posts.csv"
    path.write_text(csv_text(rows), encoding="utf-8", newline="")
    whole = rows_of(readers.read_csv(spark, str(path), "text string, label string"))
    assert [r[0] for r in whole] == list(range(len(rows)))
    for part, cell in ((23, 1), (64, 40), (1 << 20, 1 << 20)):
        cut(part, cell)
        df = readers.read_csv(spark, str(path), "text string, label string", ranges=True)
        assert rows_of(df) == whole
    cut(11, 30)
    assert rows_of(readers.read_records(spark, str(path), ranges=True)) == rows_of(readers.read_records(spark, str(path)))


def test_csv_other_breaks_bytes_and_blank_lines(spark, cut, tmp_path):
    (tmp_path / "crlf.csv").write_bytes(b'text,label\r\n"a\r\nb",1\r\n\r\nplain,2\r\n"end ""q""",3')
    (tmp_path / "bytes.csv").write_bytes(b'text,label\n"caf\xe9\n\xff",1\n5" pipe,2\n\nlast,"3"\n')
    for name in ("crlf.csv", "bytes.csv"):
        whole = rows_of(readers.read_csv(spark, str(tmp_path / name), "text string, label int"))
        assert len(whole) == 3
        for part in (3, 8):
            cut(part, part)
            assert rows_of(readers.read_csv(spark, str(tmp_path / name), "text string, label int", ranges=True)) == whole


def test_csv_files_in_path_order(spark, cut, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.csv").write_text(csv_text([(f"{k} {i}\n", "x") for i in range(k + 2)]), newline="")
    cut(9, 9)
    df = readers.read_csv(spark, str(tmp_path), "text string, label string", ranges=True)
    assert [r[1] for r in rows_of(df)] == [f"{k} {i}\n" for k in range(3) for i in range(k + 2)]
    assert [r[0] for r in rows_of(df)] == list(range(9))


def test_csv_errors_and_edges(spark, cut, tmp_path):
    (tmp_path / "many.csv").write_text("text,label\na,1,2\n")
    (tmp_path / "kind.csv").write_text("text,label\na,no\n")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "header.csv").write_text("text,label\n")
    for name in ("many.csv", "kind.csv"):
        with pytest.raises(Exception, match="too many fields|is not int"):
            readers.read_csv(spark, str(tmp_path / name), "text string, label int", ranges=True).collect()
    for name in ("none.csv", "header.csv"):
        assert readers.read_csv(spark, str(tmp_path / name), "text string, label int", ranges=True).collect() == []
    with pytest.raises(ValueError, match="schema"):
        readers.read_csv(spark, str(tmp_path / "kind.csv"), ranges=True)
    plain = tmp_path / "plain.csv"
    plain.write_text('pos,"a\nb"\nneg,c\n')
    assert rows_of(readers.read_headerless(spark, str(plain), ranges=True)) == [(0, "pos", "a\nb"), (1, "neg", "c")]


def test_many_tasks_and_no_shuffle_of_texts(spark, cut, tmp_path):
    path = tmp_path / "large.csv"
    path.write_text(csv_text([(f"line {i}\nmore", str(i)) for i in range(1000)]), newline="")
    cut(1000, 300)
    df = readers.read_csv(spark, str(path), "text string, label int", ranges=True)
    assert df.where(F.col("row_id") != F.col("label")).isEmpty() and df.count() == 1000
    # Only pieces of records that span cells are grouped.
    plan = ranges.csv_records(spark, str(path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "open" in plan


@pytest.mark.parametrize("indent", [None, 2])
def test_json_at_every_cut(spark, cut, tmp_path, indent):
    draw = random.Random(5)
    texts = ['a "b" c', "}{", "][", "back\\slash\\", '\\"}', "", "é漢", "line\nbreak", '{"x": [1, 2]}', "\\\\\"}"]
    rows = [{"text": draw.choice(texts), "labels": [draw.choice(texts) for _ in range(draw.randint(0, 3))], "at": {"k": i}} for i in range(40)]
    path = tmp_path / "rows.json"
    path.write_text(json.dumps(rows, indent=indent, ensure_ascii=False) + "\n", encoding="utf-8")
    schema = "text string, labels array<string>, at struct<k:long>"
    whole = rows_of(readers.read_json_array(spark, str(path), schema))
    assert len(whole) == 40
    for part, cell in ((41, 1), (64, 50), (1 << 20, 1 << 20)):
        cut(part, cell)
        assert rows_of(readers.read_json_array(spark, str(path), schema, ranges=True)) == whole


def test_json_edges(spark, cut, tmp_path):
    for name, text in {"none.json": "[]", "blank.json": " [ \n ] \n"}.items():
        (tmp_path / name).write_text(text)
        assert readers.read_json_array(spark, str(tmp_path / name), "a int", ranges=True).collect() == []
    cut(4, 4)
    for name, text in {"cut.json": '[{"a": 1}, {"a": 2}', "word.json": '[{"a": 1}, {"a": "x"}]', "open.json": '[{"a": 1}, {"a": {"b": 1}]'}.items():
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="array of objects|MALFORMED_RECORD|PARSE"):
            readers.read_json_array(spark, str(tmp_path / name), "a int", ranges=True).collect()
    (tmp_path / "two.json").write_text('[{"a": 1},{"a": 2}]')
    assert rows_of(readers.read_json_array(spark, str(tmp_path / "two.json"), "a int", ranges=True)) == [(0, 1), (1, 2)]
