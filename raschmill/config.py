"""Names of a response table's columns, and the options of a fit."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ResponseSchema:
    """A long table: one row for each answer of a person to an item of a scale."""

    id: str = "id"
    score: str = "score"
    item: str = "Item"
    scale: str = "Scale"

    def standard(self, df: DataFrame, extra: tuple[str, ...] = (), cast: bool = True) -> DataFrame:
        """Only the named columns, as id, Item, Scale, score, and the extra ones; without a scale column there is one scale, '1'.

        ``cast`` makes scores integers; a check of what they are comes before it.
        """
        score = F.col(self.score).cast("int") if cast else F.col(self.score)
        scale = F.col(self.scale) if self.scale in df.columns else F.lit("1")
        return df.select(F.col(self.id).alias("id"), F.col(self.item).alias("Item"), scale.alias("Scale"), score.alias("score"), *[F.col(c) for c in extra])


@dataclass(frozen=True)
class Priors:
    """Normal priors of the raw parameters; ability values by scale, with ``default`` for scales not named."""

    a_mean: float = 0.542
    a_sd: float = 1.0
    b_mean: float = 0.0
    b_sd: float = 10.0
    c_mean: float = -4.0
    c_sd: float = 4.0
    d_mean: float = 4.0
    d_sd: float = 4.0
    ability_mean: Mapping[str, float] = field(default_factory=dict)
    ability_sd: Mapping[str, float] = field(default_factory=dict)
    default_mean: float = 0.0
    default_sd: float = 10.0
    #: (scale, scale) -> correlation, both orders; missing pairs are 0, the diagonal is 1.
    ability_corr: Mapping[tuple[str, str], float] = field(default_factory=dict)
    beta_sd: float = 10.0


@dataclass(frozen=True)
class IrtConfig:
    """Options of fit_irt. ``pl``: 1 difficulties only, 2 also slopes, 3 also lower, 4 also upper asymptotes."""

    pl: int = 1
    person_preds: tuple[str, ...] = ()
    a_preds: tuple[str, ...] = ()
    b_preds: tuple[str, ...] = ()
    c_preds: tuple[str, ...] = ()
    d_preds: tuple[str, ...] = ()
    #: Each item has its own effects of item covariates, instead of one effect for all.
    item_specific_betas: bool = False
    priors: Priors = field(default_factory=Priors)
    use_priors: bool = True
    #: Means that are estimated (as the average of their elements) rather than taken from the priors.
    est_means: tuple[str, ...] = ("ability", "B", "C", "D")
    careful: bool = False
    ebayes: bool = True
    ebayes_multiplier: float = 2.0
    priors_from_fixed: bool = False
    normalise: bool = False
    normalise_scale: float = 1.0
    normalise_mean: float = 0.0
    drop_perfect_scores: bool = True
    perfect_tol: float = 0.001
    #: Name of a boolean column; rows where it is false are predicted but do not enter the fit.
    training: str | None = None
    #: Nodes over which the likelihood of an answer is integrated along its person's ability; 0: at the ability alone.
    integrate_points: int = 0
    #: Deviation of that integral; None: from the curvature of the likelihood at the abilities, anew in each sweep. 0 for fixed abilities.
    integrate_sd: float | None = None
    max_sweeps: int = 100
    #: Absolute change of the objective at which a stage ends; None: 1e-8 for each row.
    tol: float | None = None

    @property
    def item_preds(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.a_preds, *self.b_preds, *self.c_preds, *self.d_preds)))

    @property
    def preds(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.person_preds, *self.item_preds)))
