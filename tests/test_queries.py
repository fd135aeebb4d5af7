"""Every query with an oracle gives the rows of its DuckDB SQL (sf0.001)."""

import os

import duckdb
import pytest

from quillstream import detail_queries, format_queries, queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(rows):
    return sorted(repr(tuple(x)) for x in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = got.select(*cols).collect()
    assert rows
    if name in queries.ORACLE:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        listed = ", ".join('"' + c + '"' for c in cols)
        want = con.execute(f"SELECT {listed} FROM ({queries.ORACLE[name]}) AS q").fetchall()
        assert canon(rows) == canon(want)


def test_scalar_edges(spark):
    from pyspark.sql import functions as F

    from quillstream.functions import text as fn

    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(fn.strip(F.lit("\x0b  a b\x1c\n"))) == "a b"
    assert one(fn.sanitize_filename(F.lit("con"))) == "_con" and one(fn.sanitize_filename(F.lit(" .. "))) == "unnamed"
    assert one(fn.hex_to_rgb(F.lit("#12345"))) is None and tuple(one(fn.hex_to_rgb(F.lit("FF0080")))) == (255, 0, 128)
    assert one(fn.suffix_format(F.lit("/a.b/c.TXT"))) == "txt" and one(fn.suffix_format(F.lit("/a/none"))) == ""
    assert one(fn.media_format(F.lit("image/jpeg"))) == "jpg" and one(fn.palm_name(F.lit("é b" + "x" * 40))) == "__b" + "x" * 28
    assert bytes(one(fn.align4(F.lit(b"abcde")))) == b"abcde\0\0\0"


def test_titled_text(spark):
    from pyspark.sql import functions as F

    from quillstream.sources import plain

    rows = spark.createDataFrame([("T\n===\nBy: me\n\na\n\nb",), ("T\n===\n\nBy: me",), ("a\n\n\nb",), (None,), ("",)], "t string")
    got = [(dict(r["d"]["metadata"] or {}), [b["data"] for b in r["d"]["content"]]) for r in rows.select(plain.read_titled_txt(F.col("t")).alias("d")).collect()]
    assert got == [({"title": "T", "author": "me"}, ["a", "b"]), ({"title": "T"}, ["By: me"]), ({}, ["a", "b"]), ({}, []), ({}, [])]


def made_tables(spark, path, **tables):
    """A folder of tables: those of sf0.001, but the given rows (with a schema) in place of some."""
    for t in TABLES:
        if t in tables:
            spark.createDataFrame(*tables[t]).coalesce(1).write.parquet(f"{path}/{t}.parquet")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{path}/{t}.parquet")
    return str(path)


def same_as_sql(spark, name, at):
    got = queries.QUERIES[name](spark, at)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{at}/{t}.parquet') else ''}')")
    listed = ", ".join('"' + c + '"' for c in got.columns)
    return canon(got.collect()) == canon(con.execute(f"SELECT {listed} FROM ({queries.ORACLE[name]}) AS q").fetchall())


def test_text_records_of_shared_ids_and_empty_texts(spark, tmp_path):
    rows = [(1, "é" * 3000), (1, "b" * 9000), (2, ""), (3, None), (4, "x" * 4096)]
    assert same_as_sql(spark, "text_records", made_tables(spark, tmp_path, documents=(rows, "doc_id long, text string")))


def test_small_files_are_spread_over_tasks(spark):
    """What takes milliseconds a row has several tasks a core, however few the files of its table are."""
    from pyspark.sql import functions as F

    most = 4 * spark.sparkContext.defaultParallelism
    for name in ("epub_metadata", "pdf_to_epub", "pdf_lines", "pdf_pages", "odt_blocks", "settings_layers", "title_from_filename", "markdown_blocks", "rtf_blocks"):
        got = queries.QUERIES[name](spark, SF).withColumn("_task", F.spark_partition_id())
        assert got.select("_task").distinct().count() > most // 2, name


@pytest.mark.parametrize("size,least", [(1 << 10, 100), (4 << 20, 4)])
def test_shuffle_partitions_grow_with_the_table(spark, size, least):
    assert queries.parts_of(spark, SF, "lineitem", size) == max(least, 4, -(-os.path.getsize(f"{SF}/lineitem.parquet") // size))


def test_spine_join_has_partitions_by_the_table(spark, monkeypatch):
    monkeypatch.setattr(queries, "parts_of", lambda *_: 37)
    plan = queries.QUERIES["spine_join"](spark, SF)._jdf.queryExecution().toString()
    assert plan.count(", 37), REPARTITION_BY_NUM") >= 4
