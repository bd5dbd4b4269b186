"""Delimited files, stages, manifest, history, listings, HTML tables, streaming append."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paneloom import schema, shared_folder
from paneloom.sources import delimited, history, html, listing, manifest, stages
from paneloom.streaming.history import append_stream
from conftest import rows

SMALL = schema.struct({"key": "string", "W/L%": "double", "on": "date"})


def test_delimited_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a;b", 0.5, dt.date(2024, 1, 2)), ('q"t', None, None)], SMALL)
    for name, compression in (("plain", None), ("packed", "gzip")):
        path = str(tmp_path / name)
        delimited.write_delimited(df, path, compression=compression)
        assert rows(delimited.read_delimited(spark, path, SMALL), "key") == rows(df, "key")
        assert delimited.read_delimited(spark, path, SMALL, nrows=1).count() == 1


def test_bad_text_is_an_error(spark, tmp_path):
    path = str(tmp_path / "bad")
    spark.createDataFrame([("a", "x")], "key string, w string").write.csv(path, header=True, sep=";")
    with pytest.raises(Exception):
        delimited.read_delimited(spark, path, schema.struct({"key": "string", "w": "int"})).collect()


def test_empty_tables_have_the_declared_schema(spark, tmp_path):
    for s in (schema.PLAYER_STATS, schema.VOTES, schema.STANDINGS, schema.HISTORY, schema.PERFORMANCES):
        assert schema.empty_table(spark, s).schema == s
    assert stages.read_or_empty(spark, str(tmp_path / "absent"), schema.HISTORY).count() == 0
    assert "EFG%_per_game" in schema.PLAYER_STATS.names and "WS/48_advanced" in schema.PLAYER_STATS.names


def test_stage_is_built_once(spark, tmp_path):
    path, calls = str(tmp_path / "stage"), []

    def build(n):
        calls.append(n)
        return spark.range(n)

    assert stages.build_once(spark, path, lambda: build(3)).count() == 3
    assert stages.build_once(spark, path, lambda: build(5)).count() == 3
    assert stages.build_once(spark, path, lambda: build(7), refresh=True).count() == 7
    assert calls == [3, 7]


def test_half_written_stage_is_built_again(spark, tmp_path):
    path = str(tmp_path / "stage")
    spark.range(2).write.parquet(path)  # data without a marker, as an interrupted build leaves them
    assert not stages.stage_exists(spark, path)
    assert stages.build_once(spark, path, lambda: spark.range(5)).count() == 5
    assert stages.stage_exists(spark, path)

    def broken():
        return spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("stop"))).alias("id"))

    with pytest.raises(Exception, match="stop"):
        stages.build_once(spark, path, broken, refresh=True)
    assert not stages.stage_exists(spark, path)
    assert stages.build_once(spark, path, lambda: spark.range(4)).count() == 4


def test_stale_stage_is_built_again(spark, tmp_path):
    path, source, calls = str(tmp_path / "stage"), str(tmp_path / "source"), []

    def build():
        calls.append(1)
        return spark.read.parquet(source).selectExpr("id * 2 AS id")

    def run(recipe="1"):
        return stages.build_once(spark, path, build, inputs=[spark.read.parquet(source)], recipe=recipe).count()

    spark.range(3).write.parquet(source)
    assert (run(), run(), len(calls)) == (3, 3, 1)
    spark.range(1).write.mode("append").parquet(source)
    assert (run(), run(), len(calls)) == (4, 4, 2)
    assert (run("2"), run("2"), len(calls)) == (4, 4, 3)
    assert stages.file_state(spark.read.parquet(source).limit(0))[0] in (0, 2)
    with pytest.raises(ValueError, match="read from files"):
        stages.fingerprint([spark.range(3)])


def test_manifest(spark, tmp_path):
    given = manifest.Features(["POS"], ["G", "W/L%"], ["G", "POS_C"])
    manifest.write_features(spark, given, str(tmp_path / "f"))
    assert manifest.read_features(spark, str(tmp_path / "f")) == given


def batch(spark, day, names, pred=1.0):
    return spark.createDataFrame([(dt.date(2024, 1, day), n, pred) for n in names], schema.HISTORY)


def shown(table):
    return rows(table.select("PLAYER", "PRED"), "DATE", "PLAYER", "PRED")


def test_history_takes_a_date_once(spark, tmp_path):
    path = str(tmp_path / "history")
    history.append_once(batch(spark, 1, "ab"), path)
    history.append_once(batch(spark, 1, "abc", 9.0), path)
    got = history.append_once(batch(spark, 2, "c"), path)
    assert shown(got) == [("a", 1.0), ("b", 1.0), ("c", 1.0)]
    undated = spark.createDataFrame([(None, "n", 0.0)], schema.HISTORY)
    history.append_once(undated, path)
    got = history.append_once(undated, path)
    assert got.schema.names == schema.HISTORY.names and got.where("DATE IS NULL").count() == 1 and got.count() == 4


@pytest.mark.parametrize("step", ["_stage", "_publish"])
def test_history_survives_an_interrupted_run(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "history")
    history.append_once(batch(spark, 1, "a"), path)
    whole = getattr(history, step)

    def stopped(*given):
        if step == "_stage":
            whole(*given)  # all data are written, nothing is published
        raise KeyboardInterrupt

    both = batch(spark, 2, "bc").unionByName(batch(spark, 3, "d"))
    with monkeypatch.context() as patch:
        patch.setattr(history, step, stopped)
        with pytest.raises(KeyboardInterrupt):
            history.append_once(both, path)
    assert shown(history.read_history(spark, path, schema.HISTORY)) == [("a", 1.0)]
    assert shown(history.append_once(both, path)) == [("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", 1.0)]
    assert shown(history.append_once(both, path)) == [("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", 1.0)]


def test_epochs(spark, tmp_path):
    path = str(tmp_path / "history")
    history.append_once(batch(spark, 9, "z"), path)
    for _ in range(2):  # each epoch is replayed
        history.append_epoch(batch(spark, 1, "ab"), path, "s", 0)
        history.append_epoch(batch(spark, 1, "c").unionByName(batch(spark, 9, "y")), path, "s", 1)
        got = history.append_epoch(batch(spark, 1, "d"), path, "other", 0)
    assert shown(got) == [("a", 1.0), ("b", 1.0), ("c", 1.0), ("z", 1.0)]
    assert shown(history.append_once(batch(spark, 1, "e"), path)) == shown(got)


def test_history_from_a_stream(spark, tmp_path):
    """A date that comes in two micro-batches keeps all its rows."""
    source, path = str(tmp_path / "in"), str(tmp_path / "history")
    batch(spark, 1, "ab").coalesce(1).write.parquet(source)
    for run in (1, 2):
        if run == 2:
            batch(spark, 2, "a").unionByName(batch(spark, 1, "z")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema.HISTORY).parquet(source)
        query = append_stream(stream, path, str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = history.read_history(spark, path, schema.HISTORY)
    assert rows(got.select("PLAYER"), "DATE", "PLAYER") == [("a",), ("b",), ("z",), ("a",)]


LISTING = """{"total_count": 3, "artifacts": [
 {"name": "p", "expired": false, "created_at": "2024-01-01T00:00:00Z", "archive_download_url": "old"},
 {"name": "p", "expired": false, "created_at": "2024-01-03T00:00:00Z", "archive_download_url": "new"},
 {"name": "p", "expired": true, "created_at": "2024-01-09T00:00:00Z", "archive_download_url": "gone"}]}"""


def test_latest_record(spark):
    df = spark.createDataFrame([(LISTING,)], "json string")
    created, url = listing.latest_record(df, "p")
    assert url == "new" and created == dt.datetime(2024, 1, 3)
    with pytest.raises(LookupError, match="no record named q"):
        listing.latest_record(df, "q")


PAGE = """<html><body><table id="other"><tr><th>X</th></tr><tr><td>1</td></tr></table>
<table id="{id}"><thead><tr><th colspan="2"></th><th>Voting</th></tr>
<tr><th>Rank</th><th>Player</th><th>Share</th></tr></thead>
<tbody><tr><td>1</td><td><a href="#">A&amp;B</a>  <b>C</b></td><td></td></tr>
<tr><td rowspan="2">2</td><td>D<td>0.5</tr><tr><td>E</td><td>0.4</td></tr></tbody></table></body></html>"""


def test_tables_are_chosen_by_id(spark):
    pages = spark.createDataFrame(
        [(1, PAGE.format(id="mvp")), (2, PAGE.format(id="nba_mvp"))], "page_id long, html string"
    )
    got = html.html_tables(pages, ["mvp", "nba_mvp"], header_row=1)
    shown = got.select("page_id", "table_id", html.cell("rank"), html.cell("PLAYER"), html.cell("Share"), html.cell("no"))
    assert rows(shown, "page_id", "row_ord") == [
        (p, i, *rest)
        for p, i in ((1, "mvp"), (2, "nba_mvp"))
        for rest in (("1", "A&B C", None, None), ("2", "D", "0.5", None), ("2", "E", "0.4", None))
    ]
    first = html.html_tables(pages)
    assert {r.table_id for r in first.collect()} == {"other"}
    assert html.header_names(got) == ["RANK", "PLAYER", "SHARE"]


def test_missing_table(spark):
    pages = spark.createDataFrame([(1, "<p>none</p>"), (2, None)], "page_id long, html string")
    assert html.html_tables(pages, ["mvp"], missing="skip").count() == 0
    assert html.html_tables(pages, ["mvp"], missing="mark").where("cells IS NULL").count() == 2
    with pytest.raises(Exception, match="no table"):
        html.html_tables(pages, ["mvp"]).collect()


def test_shared_folder_is_below_the_checkpoint_folder(spark):
    from paneloom.session import checkpoint_folder

    assert shared_folder(spark, "x").startswith(checkpoint_folder(spark))
    assert shared_folder(spark, "x") != shared_folder(spark, "x")


def test_round_trip_of_rendered_rows(spark):
    cells = spark.range(50).select(F.concat(F.lit("<tr><td>"), "id", F.lit("</td></tr>")).alias("row"))
    page = cells.agg(F.array_join(F.sort_array(F.collect_list("row")), "").alias("body")).select(
        F.lit(1).cast("long").alias("page_id"),
        F.concat(F.lit("<table><tr><th>id</th></tr>"), "body", F.lit("</table>")).alias("html"),
    )
    back = html.html_tables(page).select(html.cell("ID").cast("long").alias("id"))
    assert [r[0] for r in rows(back, "id")] == list(range(50))
