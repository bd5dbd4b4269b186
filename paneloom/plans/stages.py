"""Bronze, silver and gold stages, training with held-out evaluation, scoring and explanation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.operators.cleaning import (
    categorical_columns, complete_columns, fill_numbers, fill_typed, numerical_columns,
)
from paneloom.operators.correlation import prune_correlated, select_features, target_correlations
from paneloom.operators.dedupe import union_names
from paneloom.operators.encode import fit_one_hot, one_hot, one_hot_names
from paneloom.operators.filters import at_least, at_most, group_threshold, removed_rows
from paneloom.operators.folds import assign_folds, fold_means, period_split
from paneloom.operators.joins import join_unique, previous_period_flags
from paneloom.operators.mlp import MLPModel, MLPRegressor
from paneloom.operators.ranks import rank_by_group
from paneloom.operators.scale import scale_by_group
from paneloom.operators.shapley import shapley
from paneloom.operators.spread import settle, stage
from paneloom.operators.summary import conditional_counts, error_metrics
from paneloom.operators.topk import top_rows
from paneloom.operators.outcomes import period_outcomes
from paneloom.schema import KEY, NOT_FEATURES, TARGET
from paneloom.sources.manifest import Features

# Silver limits, correlation limits, test share, rows scored and rows explained.
SHARE_OF_GAMES = 0.6
MIN_ATTEMPTS = 2
MAX_CONF_RANK = 8
MIN_MINUTES = 28.0
MAX_FEATURE_CORRELATION = 0.95
MIN_TARGET_CORRELATION = 0.05
TEST_SHARE = 0.2
KEPT_PREDICTIONS = 50
EXPLAINED_ROWS = 10
CORRELATION_METHODS = ("pearson", "kendall", "spearman")
FOLDS, FOLD_REPEATS = 3, 2


def bronze(
    players: DataFrame, votes: DataFrame, standings: DataFrame, *, on_duplicate: str = "raise", same_team: bool = True
) -> DataFrame:
    """Players with their votes, their team's standing and the flags of the season before.

    Unmatched votes become false and 0; rows without a standing (such as totals over several teams) drop out.
    """
    votes = votes.drop(KEY)
    standings = standings.drop("TEAM_SEASON")
    joined = join_unique(players, votes, ["PLAYER", "TEAM", "SEASON"], "left", on_duplicate=on_duplicate)
    joined = join_unique(joined, standings, ["TEAM", "SEASON"], "inner", on_duplicate=on_duplicate)
    # Read twice from here on: for the rows and for the flags.
    joined = stage(joined)
    keys = ["PLAYER", "TEAM"] if same_team else ["PLAYER"]
    won, podium = F.col("MVP_WINNER"), F.col("MVP_PODIUM")
    flagged = previous_period_flags(
        joined,
        keys,
        "SEASON",
        {"PREVIOUS_SEASON_MVP_PODIUM_NOT_WINNER": podium & ~won, "PREVIOUS_SEASON_MVP_WINNER": won},
    )
    return fill_typed(
        flagged, {"MVP_WINNER": False, "MVP_PODIUM": False, "MVP_CANDIDATE": False, TARGET: 0.0}
    )


def silver(
    data: DataFrame,
    *,
    share_of_games: float = SHARE_OF_GAMES,
    min_attempts: float = MIN_ATTEMPTS,
    max_conf_rank: int = MAX_CONF_RANK,
    min_minutes: float = MIN_MINUTES,
) -> DataFrame:
    """Regulars of good teams: enough games for their season, attempts, minutes and a high standing."""
    # The season's maximum is taken before the row filters, as their order matters.
    regular = group_threshold(data, "SEASON", "G", share_of_games)
    return at_most(
        at_least(regular, {"FGA_per_game": min_attempts, "MP": min_minutes}), {"CONF_RANK": max_conf_rank}
    )


def filter_audit(before: DataFrame, after: DataFrame, key: str = KEY) -> DataFrame:
    """Counts before and after the filters, and the candidates they removed."""
    conditions = {"candidates": F.col("MVP_CANDIDATE"), "winners": F.col("MVP_WINNER")}
    counts = [
        conditional_counts(df, conditions).withColumn("stage", F.lit(stage))
        for stage, df in (("before", before), ("after", after))
    ]
    lost = removed_rows(before, after, [key], F.col("MVP_CANDIDATE"))
    return counts[0].unionByName(counts[1]).unionByName(
        conditional_counts(lost, conditions).withColumn("stage", F.lit("removed"))
    )


@dataclass(frozen=True)
class GoldRecipe:
    """What gold needs to know before it can be a lazy transformation."""

    num: list[str]
    cat: list[str]
    levels: dict[str, list[str]]

    @property
    def encoded(self) -> list[str]:
        """Names of the columns that stand for the categorical ones."""
        plain = [c for c in self.cat if c not in self.levels]
        return plain + one_hot_names(self.levels)


def fit_gold(
    data: DataFrame,
    *,
    not_features: Sequence[str] = NOT_FEATURES,
    key: str = KEY,
    max_correlation: float = MAX_FEATURE_CORRELATION,
    include_perfect: bool = False,
) -> GoldRecipe:
    """Split columns by type, prune correlated numbers and note the levels of the text columns."""
    features = data.drop(*not_features, key)
    num = prune_correlated(
        features, numerical_columns(features), max_correlation, include_perfect=include_perfect
    )
    cat = categorical_columns(features)
    return GoldRecipe(num, cat, fit_one_hot(features, cat))


def gold(
    data: DataFrame,
    recipe: GoldRecipe,
    *,
    not_features: Sequence[str] = NOT_FEATURES,
    key: str = KEY,
    target: str = TARGET,
    period: str = "SEASON",
    method: str = "std",
) -> DataFrame:
    """Numbers scaled within their season, indicators, the descriptive columns and the rank by votes."""
    chosen = data.select(*[F.col(f"`{c}`") for c in [key, *recipe.num, *recipe.cat, *not_features]])
    ranked = rank_by_group(chosen, [period], target, "MVP_RANK", method="min")
    return one_hot(scale_by_group(ranked, recipe.num, group=period, method=method), recipe.levels)


def choose_features(
    gold_data: DataFrame,
    recipe: GoldRecipe,
    *,
    target: str = TARGET,
    threshold: float | None = MIN_TARGET_CORRELATION,
    top_n: int | None = None,
    methods: Sequence[str] = CORRELATION_METHODS,
) -> Features:
    """Numbers that correlate with the target by any method and hold no null, plus all indicators."""
    picked = [
        select_features(
            target_correlations(gold_data, recipe.num, target, m), threshold=threshold, top_n=top_n
        )
        for m in methods
    ]
    names = union_names(*picked)
    complete = complete_columns(gold_data, names) if names else []
    return Features(list(recipe.cat), list(recipe.num), complete + recipe.encoded)


@dataclass
class Training:
    """Results of a training run."""

    features: Features
    model: MLPModel
    validation: DataFrame
    test: DataFrame
    held_out: DataFrame
    performances: DataFrame


def _as_numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Model columns as doubles (indicators may be booleans)."""
    return df.withColumns({c: F.col(f"`{c}`").cast("double") for c in names})


def train(
    gold_data: DataFrame,
    recipe: GoldRecipe,
    *,
    current_season: int,
    regressor: MLPRegressor | None = None,
    target: str = TARGET,
    period: str = "SEASON",
    key: str = KEY,
    label: str = "PLAYER",
) -> Training:
    """Select features, cross-validate, evaluate by season and fit on all past seasons."""
    regressor = regressor or MLPRegressor()
    past = gold_data.where(F.col(period) < current_season)
    trainval, test = period_split(past, period, TEST_SHARE)
    features = choose_features(trainval, recipe, target=target)
    past = _as_numbers(past, features.model)
    trainval, test = (_as_numbers(df, features.model) for df in (trainval, test))
    validation, tested = cross_validate(
        trainval, features.model, regressor, target=target, key=key, test=test
    )
    # Read several times: for the winners, for their ranks and by the caller.
    held_out = settle(hold_out_periods(past, features.model, regressor, target=target, period=period))
    return Training(
        features=features,
        model=regressor.fit(past, features.model, target),
        validation=validation,
        test=tested,
        held_out=held_out,
        performances=period_outcomes(held_out, period, key, target, "PRED", label=label),
    )


def cross_validate(
    data: DataFrame,
    features: Sequence[str],
    regressor: MLPRegressor,
    *,
    target: str = TARGET,
    key: str = KEY,
    test: DataFrame | None = None,
    splits: int = FOLDS,
    repeats: int = FOLD_REPEATS,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame | None]:
    """Errors averaged over repeated folds, on the rows trained on and on the rows left out.

    All fits share their passes over the data. With ``test`` also the errors of a fit on all of ``data`` there.
    """
    folded, names = assign_folds(data, key, splits, repeats=repeats, seed=seed)
    folded = stage(folded)
    model = regressor.fit(folded, features, target, fold_cols=names)
    per_set = [
        F.struct(
            F.lit(f"{f}={v}").alias("fold"),
            F.when(F.col(f) == v, F.lit("validation")).otherwise(F.lit("training")).alias("part"),
            F.col("_all")[k].alias("PRED"),
        )
        for k, (f, v) in enumerate(model.held_out)
    ]
    scored = model.transform_all(folded, "_all").select(
        F.col(target).alias("truth"), F.inline(F.array(*per_set))
    )
    per_fold = error_metrics(scored, "truth", "PRED", ["fold", "part"])
    means = fold_means(per_fold, ["mae", "mse", "max_error"], ["part"])
    tested = None
    if test is not None:
        tested = error_metrics(regressor.fit(data, features, target).transform(test, "PRED"), target, "PRED")
    return means, tested


def hold_out_periods(
    data: DataFrame, features: Sequence[str], regressor: MLPRegressor, *, target: str = TARGET, period: str = "SEASON"
) -> DataFrame:
    """Every row predicted by a fit that never saw its period."""
    model = regressor.fit(data, features, target, fold_cols=[period])
    return model.transform_held_out(data, period, "PRED")


def score_inputs(
    silver_data: DataFrame, features: Features, levels: dict[str, list[str]], *, season: int, period: str = "SEASON"
) -> DataFrame:
    """The season's rows with nulls as 0, then scaled and encoded with the stored levels."""
    current = fill_numbers(silver_data.where(F.col(period) == season))
    return one_hot(scale_by_group(current, features.num, group=period), levels)


def score(
    silver_data: DataFrame,
    model: MLPModel,
    features: Features,
    levels: dict[str, list[str]],
    *,
    season: int,
    key: str = KEY,
    period: str = "SEASON",
    max_n: int | None = KEPT_PREDICTIONS,
) -> DataFrame:
    """Silver columns of the season with ``PRED`` and ``PRED_RANK``: the best ``max_n``, positive ones only.

    The rank is taken over the whole season, before the cut.
    """
    inputs = score_inputs(silver_data, features, levels, season=season, period=period)
    predicted = model.transform(inputs, "PRED").select(key, "PRED")
    current = fill_numbers(silver_data.where(F.col(period) == season))
    ranked = rank_by_group(current.join(predicted, key), [], "PRED", "PRED_RANK", method="average")
    if max_n is not None:
        ranked = top_rows(ranked, max_n, [F.col("PRED").desc(), F.col(key).asc()])
    return ranked.where(F.col("PRED") > 0)


def explain(
    inputs: DataFrame,
    predictions: DataFrame,
    model: MLPModel,
    *,
    key: str = KEY,
    label: str = "PLAYER",
    rows: int = EXPLAINED_ROWS,
    permutations: int = 10,
    seed: int = 0,
) -> DataFrame:
    """Attributions of the best ranked rows against everything that was scored: ``label, feature, phi``."""
    best = top_rows(predictions, rows, [F.col("PRED_RANK").asc(), F.col(key).asc()]).select(key, label)
    sample = inputs.join(best.select(key), key, "left_semi")
    phi = shapley(
        sample, inputs, key, model.features, model.predict_array, permutations=permutations, seed=seed
    )
    return phi.join(best, key).select(label, "feature", "phi")
