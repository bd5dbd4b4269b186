"""Bronze to report on a small hand-made league."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneloom.operators.mlp import MLPRegressor
from paneloom.plans import reports, stages
from conftest import rows


@pytest.fixture(scope="module")
def league(spark):
    rng = np.random.default_rng(5)
    players, votes, standings = [], [], []
    for season in range(2000, 2008):
        for t in range(4):
            team = f"T{t}"
            standings.append((f"{team}_{season}", team, "EAST" if t < 2 else "WEST", 40 + t, 42 - t, 0.5 + t / 100, t + 1, season))
            for p in range(6):
                name = f"P{t}{p}"
                pts = float(10 + 3 * p + 8 * rng.normal())
                players.append(
                    (f"{name}_{season}_{team}", name, "C" if p % 2 else "PG", team, season, 82 - p * 9, 40.0 - p, 5.0 + p,
                     pts, pts * 0.9 + float(rng.normal()) * 0.01, float(rng.normal()))
                )
                if p == 1 and t == season % 4:
                    votes.append((f"{name}_{season}_{team}", name, team, season, 0.8, True, True, True))
                if p == 0 and t == (season + 1) % 4:
                    votes.append((f"{name}_{season}_{team}", name, team, season, 0.2, False, True, True))
        players.append((f"P00_{season}_TOT", "P00", "C", "TOT", season, 82, 40.0, 5.0, 20.0, 18.0, 0.0))
    key = "player_season_team string, "
    return (
        spark.createDataFrame(players, key + "PLAYER string, POS string, TEAM string, SEASON int, G int, MP double, "
                              "FGA_per_game double, PTS_per_game double, FG_per_game double, NOISE_advanced double"),
        spark.createDataFrame(votes, key + "PLAYER string, TEAM string, SEASON int, MVP_VOTES_SHARE double, "
                              "MVP_WINNER boolean, MVP_PODIUM boolean, MVP_CANDIDATE boolean"),
        spark.createDataFrame(standings, "TEAM_SEASON string, TEAM string, CONF string, W int, L int, `W/L%` double, "
                              "CONF_RANK int, SEASON int"),
    )


@pytest.fixture(scope="module")
def bronze(league):
    return stages.bronze(*league).cache()


def test_bronze(bronze, league):
    assert bronze.where("TEAM = 'TOT'").count() == 0
    assert bronze.where("MVP_CANDIDATE").count() == 16
    assert bronze.where("MVP_VOTES_SHARE IS NULL OR MVP_WINNER IS NULL").count() == 0
    players, votes, standings = league
    with pytest.raises(ValueError, match="repeated rows"):
        stages.bronze(players, votes.unionAll(votes.limit(1)), standings)


def test_previous_season_flags(bronze):
    flagged = bronze.where("PREVIOUS_SEASON_MVP_WINNER").select("PLAYER", "SEASON")
    assert rows(flagged, "SEASON")[:2] == [("P01", 2001), ("P11", 2002)]
    second = bronze.where("PREVIOUS_SEASON_MVP_PODIUM_NOT_WINNER").select("PLAYER", "SEASON")
    assert rows(second, "SEASON")[:2] == [("P10", 2001), ("P20", 2002)]


def test_silver_and_audit(bronze):
    kept = stages.silver(bronze)
    limits = kept.agg(F.min("G"), F.min("MP"), F.max("CONF_RANK"), F.min("FGA_per_game")).first()
    assert limits[0] >= 0.6 * 82 and limits[1] >= 28 and limits[2] <= 8 and limits[3] >= 2
    audit = {r.stage: (r.rows, r.candidates, r.winners) for r in stages.filter_audit(bronze, kept).collect()}
    assert audit["before"] == (192, 16, 8) and audit["after"][0] == kept.count()
    assert audit["before"][1] - audit["after"][1] == audit["removed"][1]


def test_gold_training_scoring_and_explanation(bronze):
    silver = stages.silver(bronze).cache()
    recipe = stages.fit_gold(silver)
    assert "FG_per_game" not in recipe.num and "PTS_per_game" in recipe.num
    assert {"POS", "CONF"} <= set(recipe.levels)
    gold = stages.gold(silver, recipe).cache()
    assert {"POS_C", "POS_PG", "CONF_EAST", "MVP_RANK", "PREVIOUS_SEASON_MVP_WINNER"} <= set(gold.columns)
    means = gold.groupBy("SEASON").agg(F.avg("PTS_per_game").alias("m")).agg(F.max(F.abs("m"))).first()[0]
    assert means < 1e-9
    done = stages.train(gold, recipe, current_season=2007, regressor=MLPRegressor(max_iter=15))
    assert set(done.features.model) >= {"POS_C", "CONF_EAST", "PREVIOUS_SEASON_MVP_WINNER"}
    assert done.performances.count() == 7 and done.held_out.where("PRED IS NULL").count() == 0
    assert done.validation.count() == 2 and done.test.count() == 1

    scored = stages.score(silver, done.model, done.features, recipe.levels, season=2007, max_n=10)
    assert scored.count() <= 10 and scored.where("PRED <= 0").count() == 0
    assert {"PRED", "PRED_RANK", "PTS_per_game"} <= set(scored.columns)
    inputs = stages.score_inputs(silver, done.features, recipe.levels, season=2007)
    phi = stages.explain(inputs, scored, done.model, rows=3, permutations=2)
    assert phi.select("feature").distinct().count() == len(done.features.model)

    report = reports.performance_report(done.performances)
    assert report.columns == reports.PERFORMANCE_COLUMNS
    assert [r.Season for r in report.collect()] == list(range(2006, 1999, -1))
    ranking = reports.ranking_report(scored, top_n=3, show=5)
    assert ranking.agg(F.sum("chance")).first()[0] == pytest.approx(100.0)


def test_history_report(spark):
    days = [dt.date(2024, 4, d) for d in (1, 2, 20)]
    history = spark.createDataFrame(
        [(days[0], "a", 1.0), (days[0], "b", 3.0), (days[1], "a", 2.0), (days[1], "b", 2.0), (days[1], "c", 0.0), (days[2], "z", 9.0)],
        "DATE date, PLAYER string, PRED double",
    )
    end = F.lit("2024-04-10").cast("date")
    built = reports.build_history(history, F.lit("2024-04-05").cast("date"), end)
    assert built.count() == 5
    got = reports.history_report(built, keep_top_n=2, mode="share").select("player", "days_ago", "rank", "chance")
    assert rows(got, F.col("days_ago").desc(), "player") == [
        ("a", 4, 2.0, 25.0), ("b", 4, 1.0, 75.0), ("a", 3, 1.5, 50.0), ("b", 3, 1.5, 50.0)
    ]
    assert reports.history_report(built, keep_top_n=2, mode="softmax", keep_last_days=3).count() == 2
