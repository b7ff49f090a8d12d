"""Parameters of the feature, similarity and build jobs."""

from __future__ import annotations

from dataclasses import dataclass, field

from akin.functions.text import STOP_WORDS


@dataclass(frozen=True)
class Weights:
    """Shares of the genre, text and metadata cosines in the mixed score."""

    genre: float = 0.4
    text: float = 0.5
    metadata: float = 0.1
    name: str = "default"

    def effective(self, normalise: bool) -> tuple[float, float, float]:
        total = self.genre + self.text + self.metadata
        if total <= 0:
            raise ValueError("the sum of the weights must be positive")
        scale = total if normalise else 1.0
        return self.genre / scale, self.text / scale, self.metadata / scale


# The weight mixes that are compared side by side.
WEIGHT_SCHEMES = (
    Weights(1.0, 1.0, 1.0, "Balanced"),
    Weights(0.3, 0.6, 0.1, "Text-Heavy"),
    Weights(0.6, 0.3, 0.1, "Genre-Heavy"),
    Weights(0.4, 0.5, 0.1, "Text+Genre"),
    Weights(0.5, 0.5, 0.0, "No Metadata"),
)


@dataclass(frozen=True)
class FeatureParams:
    max_terms: int = 500
    min_df: int = 2
    max_df: float = 0.8
    top_platforms: int = 20
    top_languages: int = 5
    stop_words: tuple[str, ...] = STOP_WORDS


@dataclass(frozen=True)
class BuildParams:
    """Everything a full build needs besides its input."""

    features: FeatureParams = field(default_factory=FeatureParams)
    weights: Weights = field(default_factory=Weights)
    top_n: int = 20
    min_similarity: float = 0.1
    # The production build mixes raw weights and averages the three metadata cosines.
    normalise_weights: bool = False
    metadata_mode: str = "mean"
    max_items: int | None = None
    page_size: int = 1000
