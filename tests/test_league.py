"""League tables from hand-made pages."""

import pytest
from pyspark.sql import functions as F

from paneloom.plans import league
from paneloom.plans.teams import team_lookup
from conftest import rows


def table(header, body, table_id=None, top=""):
    head = "<tr>" + "".join(f"<th>{h}</th>" for h in header) + "</tr>"
    lines = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in line) + "</tr>" for line in body)
    mark = f' id="{table_id}"' if table_id else ""
    return f"<table{mark}>{top}{head}{lines}</table>"


def test_player_stats(spark):
    games = table(
        ["Rk", "Player", "Pos", "Tm", "G", "MP", "3P", "PTS", "Awards"],
        [
            [1, "Luka D. O'Neal*", "PG", "DAL", 70, 36.5, "", 30.1, "x"],
            ["Rk", "Player", "Pos", "Tm", "G", "MP", "3P", "PTS", "Awards"],
            [2, "Two Teams", "C", "BOS", 40, 20, 1, 10, ""],
            [2, "Two Teams", "C", "BOS", 41, 21, 2, 11, ""],
        ],
    )
    advanced = table(
        ["Rk", "Player", "Tm", "G", "MP", "WS/48"],
        [[1, "Luka D. O'Neal*", "DAL", 1, 9, 0.2], [3, "Late Entry", "LAL", 5, 100, 0.1]],
    )
    older = table(["Player", "Tm", "G", "PTS"], [["Old Man", "BOS", "", 3]])
    older_advanced = table(["Player", "Tm", "G", "WS/48"], [["Old Man", "BOS", 12, 0.05]])
    pages = spark.createDataFrame(
        [
            (1, 2001, "per_game", games), (2, 2001, "advanced", advanced),
            (3, 2000, "per_game", older), (4, 2000, "advanced", older_advanced),
            (5, 2001, "totals", games),
        ],
        "page_id long, season int, stat_type string, html string",
    )
    got = league.player_stats(pages)
    shown = rows(
        got.select("player_season_team", "PLAYER", "G", "MP", "3P_per_game", "PTS_per_game", "`WS/48_advanced`"),
        "player_season_team",
    )
    assert shown == [
        ("LateEntry_2001_LAL", None, None, None, None, None, 0.1),
        ("LukaDONeal_2001_DAL", "LukaDONeal", 70.0, 36.5, 0.0, 30.1, 0.2),
        # No game count in that season's first table: the next table decides.
        ("OldMan_2000_BOS", "OldMan", 12.0, None, None, 3.0, 0.05),
        ("TwoTeams_2001_BOS", "TwoTeams", 40.0, 20.0, 1.0, 10.0, None),
    ]
    assert not any("totals" in c or "RK" in c for c in got.columns)
    assert league.player_stats(pages, teams=["bos"], seasons=[2001]).count() == 1


def test_votes(spark):
    top = '<tr><th colspan="3"></th><th>Voting</th></tr>'
    page = table(
        ["Rank", "Player", "Tm", "Share"], [["1", "A B*", "BOS", 0.9], ["2T", "C", "LAL", 0.1], ["2T", "D", "LAL", 0.1]],
        "nba_mvp", top,
    )
    pages = spark.createDataFrame([(1, 2001, page)], "page_id long, season int, html string")
    assert rows(league.votes(pages), "player_season_team") == [
        ("AB_2001_BOS", "AB", "BOS", 2001, 0.9, True, True, True),
        ("C_2001_LAL", "C", "LAL", 2001, 0.1, False, True, True),
        ("D_2001_LAL", "D", "LAL", 2001, 0.1, False, True, True),
    ]
    empty = spark.createDataFrame([(1, 2001, "<p/>")], pages.schema)
    with pytest.raises(Exception, match="no table"):
        league.votes(empty).collect()


def test_standings(spark):
    header = ["Eastern Conference", "W", "L", "W/L%", "GB", "PW", "PL", "PS/G", "PA/G"]
    east = table(
        header,
        [
            ["Atlantic Division"] * 9,
            ["Philadelphia 76ers*", 50, 32, 0.61, 6, 49, 33, 100, 99],
            ["Boston Celtics*", 56, 26, 0.683, "—", 55, 27, 110, 100],
            ["Miami Heat", 50, 32, 0.61, 6, 48, 34, 100, 99],
            ["", 1, 2, 0.3, 4, 5, 6, 7, 8],
        ],
        "standings_e",
    )
    west = table(["Western Conference", *header[1:]], [["Utah Jazz", 40, 42, 0.488, 10, 41, 41, 100, 101]], "standings_w")
    pages = spark.createDataFrame([(1, 2001, east + west)], "page_id long, season int, html string")
    got = league.standings(pages, team_lookup(spark))
    assert rows(got.select("TEAM_SEASON", "CONF", "CONF_RANK", "W", "GB"), "CONF", "CONF_RANK") == [
        ("BOS_2001", "EASTERN_CONF", 1, 56, 0.0),
        ("MIA_2001", "EASTERN_CONF", 2, 50, 6.0),
        ("PHI_2001", "EASTERN_CONF", 3, 50, 6.0),
        ("UTA_2001", "WESTERN_CONF", 1, 40, 10.0),
    ]
    dated = pages.select("page_id", F.lit("2001-03-01").cast("date").alias("as_of"), "html")
    assert league.standings(dated, team_lookup(spark), period="as_of").count() == 4
    unknown = pages.withColumn("html", F.replace("html", F.lit("Utah Jazz"), F.lit("Nowhere Men")))
    with pytest.raises(Exception, match="unmapped value: NOWHEREMEN"):
        league.standings(unknown, team_lookup(spark)).collect()


GAMES = ["Date", "Start (ET)", "Visitor/Neutral", "PTS", "Home/Neutral", "PTS", "", "Attend.", "Notes"]


def game(day, visitor, home):
    return [day, "7p", visitor, 100, home, 90, "Box", "1000", ""]


def test_schedule(spark):
    first = table(GAMES, [game("Tue, Oct 2, 2000", "A", "B"), game("Wed, Oct 3, 2000", "B", "A")], "schedule")
    second = table(
        GAMES,
        [game("Sun, Apr 1, 2001", "A", "B"), ["Playoffs"], game("Mon, Apr 9, 2001", "A", "B"), game("Mon, Apr 9, 2001", "A", "B"),
         ["Playoffs"], game("Tue, Apr 10, 2001", "B", "A")],
        "schedule",
    )
    other = table(GAMES, [game("Sun, Aug 16, 2020", "A", "B"), ["Playoffs"], game("Mon, Aug 17, 2020", "A", "B")], "schedule")
    unsplit = table(GAMES, [game("Tue, Oct 2, 1990", "A", "B")], "schedule")
    pages = spark.createDataFrame(
        [(1, 2001, first), (2, 2001, second), (3, 2020, other), (4, 1990, unsplit), (5, 2001, "<p/>")],
        "page_id long, season int, html string",
    )
    regular = league.schedule(pages).select("SEASON", F.date_format("DATE", "MMdd"), "VISITOR", "HOME_PTS")
    assert rows(regular, "SEASON", "DATE") == [
        (1990, "1002", "A", 90), (2001, "1002", "A", 90), (2001, "1003", "B", 90), (2001, "0401", "A", 90),
        (2020, "0816", "A", 90),
    ]
    playoffs = league.schedule(pages, playoffs=True).select("SEASON", F.date_format("DATE", "MMdd"))
    assert rows(playoffs, "SEASON", "DATE") == [(2001, "0409"), (2001, "0410"), (2020, "0817")]


def test_lookup_is_many_to_one(spark):
    lookup = team_lookup(spark)
    assert lookup.count() == 64 and lookup.where("code = 'MIL'").count() == 2
    assert lookup.where("raw_name = 'PHILADELPHIAERS'").first().code == "PHI"
