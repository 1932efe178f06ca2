"""Parameters of a run; defaults are the published ones of the computation."""

from __future__ import annotations

from dataclasses import dataclass

from basketmill.functions.time import month_minus, previous_months


@dataclass(frozen=True)
class CandidateParams:
    # Default window lengths and list sizes.
    personal_days: int = 270
    recent_days: int = 90
    personal_top: int = 80
    global_top: int = 60
    recent_global_top: int = 60
    location_top: int = 50
    recent_location_top: int = 50
    cobuy_top: int = 20
    category_top: int = 20
    brand_top: int = 20
    user_categories: int = 5
    user_brands: int = 8
    max_anchors: int = 40
    # Item pairs of one bill that one task counts; larger bills are split by anchor.
    pairs_per_chunk: int = 1_000_000

    @property
    def anchors(self) -> int:
        return min(self.personal_top, self.max_anchors)


@dataclass(frozen=True)
class SplitMonths:
    train: tuple[str, ...]
    validation: str
    test: str


@dataclass(frozen=True)
class RunParams:
    candidates: CandidateParams = CandidateParams()
    # Sampling, model size and ranking depth.
    negative_ratio: float = 6.0
    # Samples of users to train on, to validate on, and to recommend for; by default all.
    max_train_users: int | None = None
    max_validation_users: int | None = None
    max_test_users: int | None = None
    seed: int = 42
    k: int = 10
    # A folder that keeps item lists from run to run, and whether to build them anew.
    lists: str | None = None
    refresh_lists: bool = False


def resolve_months(
    validation: str, test: str, train: list[str] | None = None, n: int = 2
) -> SplitMonths:
    """Train on the given months, else on the ``n`` months before validation."""
    months = tuple(train) if train else tuple(previous_months(validation, n))
    return SplitMonths(months, validation, test)


def full_year_months(test: str) -> SplitMonths:
    """Train on the eleven months before the last full month, then predict ``test``."""
    validation = month_minus(test, 1)
    return SplitMonths(tuple(previous_months(validation, 11)), validation, test)
