import json
import tracemalloc
from pathlib import Path

import pytest
from pyspark.sql.datasource import EqualNullSafe, EqualTo, GreaterThan, In, IsNotNull, IsNull
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexspan import queries, stored
from lexspan.sources import paged

ROWS = [{"id": i, "title": None if i % 4 == 0 else f"t{i}", "language": ["es", "fr", None][i % 3], "text": "é" * i} for i in range(25)]


@pytest.fixture
def folder(tmp_path):
    for k in range(5):
        (tmp_path / f"page-{k}.json").write_text(json.dumps({"count": 25, "next": None, "results": ROWS[5 * k : 5 * k + 5]}))
    (tmp_path / "page-empty.json").write_text("")
    (tmp_path / "page-none.json").write_text('{"results": []}\n')
    (tmp_path / "_SUCCESS").write_text("x")
    return f"file://{tmp_path}"


@pytest.mark.parametrize("condition", ["true", "language = 'es'", "language in ('es', 'fr') and id > 7", "title is null", "title is not null and language <=> null", "id = 3 or id = 4", "language = 'xx'"])
def test_rows_of_pages_under_filters(spark, folder, condition):
    got = sorted(tuple(r) for r in paged.read_pages(spark, folder).where(condition).select("id", "text").collect())
    plain = spark.createDataFrame([tuple(r.values()) for r in ROWS], paged.CATALOGUE).where(condition).select("id", "text").collect()
    assert got == sorted(map(tuple, plain))


def test_a_task_for_each_page_and_filters_at_the_source(spark, folder):
    assert paged.read_pages(spark, folder).rdd.getNumPartitions() == 6
    reader = paged.PagesReader(StructType([StructField("id", LongType()), StructField("language", StringType())]), {"path": folder})
    rest = list(reader.pushFilters([EqualTo(("language",), "es"), GreaterThan(("id",), 3)]))
    assert rest == [GreaterThan(("id",), 3)]
    assert [r for p in reader.partitions() for r in reader.read(p)] == [(r["id"], "es") for r in ROWS if r["language"] == "es"]


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_paths_with_and_without_a_scheme(spark, folder, prefix):
    path = prefix + folder.removeprefix("file://")
    assert paged.read_pages(spark, path).count() == 25
    reader = paged.PagesReader(StructType([StructField("id", LongType())]), {"path": path})
    assert sorted(r[0] for p in reader.partitions() for r in reader.read(p)) == list(range(25))


@pytest.mark.parametrize("name", ["paged_catalogue", "catalogue_skips"])
def test_queries_under_a_plain_folder(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(stored, "shared_dir", lambda spark: str(tmp_path))
    assert queries.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_filters_treat_null_as_sql_does():
    row = {"a": 1, "b": None}
    holds = lambda f: paged.passes([f])(row)
    assert holds(EqualTo(("a",), 1)) and not holds(EqualTo(("b",), None)) and holds(EqualNullSafe(("b",), None))
    assert holds(In(("a",), (1, 2))) and not holds(In(("b",), (None, 1))) and holds(IsNull(("c",))) and not holds(IsNotNull(("b",)))


def test_pages_are_tried_again():
    asked = []

    def read():
        asked.append(1)
        if len(asked) < 3:
            raise OSError("busy")
        return b"x"

    assert paged.retried(read, 3, 0.0) == b"x" and len(asked) == 3
    asked.clear()
    with pytest.raises(OSError):
        paged.retried(read, 2, 0.0)


def test_lines_of_ranges_are_those_of_the_file():
    data = b"\r\nab\n\ncde\r\nf\rghijkl\xc2\x85\xe2\x80\xa8m\n" + b"n" * 9 + b"\no"
    whole = [x for x in data.splitlines() if x]
    for step in range(1, len(data) + 1):
        for piece in (1, 2, 5, 100):
            got = [list(paged.lines(lambda at, piece=piece: data[at : at + piece], k, min(k + step, len(data)))) for k in range(0, len(data), step)]
            assert [x for part in got for x in part if x] == whole


def test_large_files_are_read_in_ranges_and_pieces(spark, tmp_path, monkeypatch):
    rows = [{"id": i, "title": "t", "language": "es", "text": "é\u2028\x85\n" * (i % 700)} for i in range(4000)]
    with (tmp_path / "pages").open("w", encoding="utf-8", newline="") as f:
        f.writelines(json.dumps({"results": rows[k : k + 40]}, ensure_ascii=False) + "\n" for k in range(0, 4000, 40))
    size = (tmp_path / "pages").stat().st_size
    monkeypatch.setattr(paged, "RANGE", size // 7)
    monkeypatch.setattr(paged, "PIECE", 10_000)
    reader = paged.PagesReader(StructType([StructField("id", LongType()), StructField("text", StringType())]), {"path": f"file://{tmp_path}"})
    parts = reader.partitions()
    assert len(parts) == 8 and max(p.end - p.start for p in parts) <= size // 7
    tracemalloc.start()
    got = [[r[0] for r in reader.read(p)] for p in parts]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(got, []) == list(range(4000)) and all(got[:-1]) and most < size / 5
    assert sorted(map(tuple, paged.read_pages(spark, f"file://{tmp_path}").select("id", "text").collect())) == [(r["id"], r["text"]) for r in rows]


def test_batches_of_long_texts_are_small(monkeypatch):
    monkeypatch.setattr(paged, "BATCH", 1000)
    schema = StructType([StructField("id", LongType()), StructField("text", StringType())])
    rows = [(i, None if i % 5 == 0 else "é" * (i % 300)) for i in range(3000)]
    made = list(paged.batches(iter(rows), schema))
    assert [tuple(r.values()) for b in made for r in b.to_pylist()] == rows and max(sum(len(t or "") for t in b.to_pydict()["text"]) for b in made) < 1300
    assert [b.num_rows for b in paged.batches(iter([(i, None) for i in range(2500)]), schema)] == [1000, 1000, 500] and not list(paged.batches(iter([]), schema))
    assert isinstance(paged.SavedPages({"path": "x"}).reader(schema), paged.BatchesReader)


def test_a_piece_that_fails_is_read_again(folder, monkeypatch):
    from pyarrow import fs

    failed = []

    class Store:
        def open_input_file(self, name):
            return self.file(name)

        class file:  # noqa: N801
            def __init__(self, name):
                self.of = fs.LocalFileSystem().open_input_file(name)

            def read_at(self, n, at):
                if at and at not in failed:  # each piece but the first, once
                    failed.append(at)
                    raise OSError("busy")
                return self.of.read_at(n, at)

    reader = paged.PagesReader(StructType([StructField("id", LongType())]), {"path": folder, "wait": 0.0})
    parts = reader.partitions()
    monkeypatch.setattr(paged, "PIECE", 50)
    monkeypatch.setattr(fs, "FileSystem", type("", (), {"from_uri": staticmethod(lambda path: (Store(), path))}))
    assert sorted(r[0] for p in parts for r in reader.read(p)) == list(range(25)) and failed


def test_pages_lie_in_as_many_files_as_the_shuffle_has_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "shared_dir", lambda spark: str(tmp_path))
    conf = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        path = queries.saved_pages(spark, "/root/testdata/sf0.01")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    pages = [json.loads(x) for x in spark.read.text(path).toPandas()["value"]]
    assert len(list(Path(path).glob("part-*"))) == 13 and sorted(p["page"] for p in pages) == list(range(25))
    assert [r["id"] for p in sorted(pages, key=lambda p: p["page"]) for r in p["results"]] == list(range(1000))
