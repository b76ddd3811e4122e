"""Named evaluators, sources and transforms with the columns they need."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from gridlake.operators import evaluation as E


@dataclass(frozen=True)
class Evaluator:
    """A report over model outputs: ``report(df, **params)`` needs the ``required`` columns."""

    name: str
    required: tuple[str, ...]
    report: Callable[..., DataFrame]
    defaults: dict = field(default_factory=dict)

    def __call__(self, df: DataFrame, **params) -> DataFrame:
        missing = [c for c in self.required if c not in df.columns]
        if missing:
            raise ValueError(f"{self.name} needs the columns {missing}")
        return self.report(df, **{**self.defaults, **params})


EVALUATORS: dict[str, Evaluator] = {}


def register_evaluator(name: str, required: tuple[str, ...], **defaults):
    def add(report: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        EVALUATORS[name] = Evaluator(name, required, report, defaults)
        return report

    return add


register_evaluator("accuracy", ("logits", "label"))(E.topk_accuracy)
register_evaluator("vision", ("logits", "label"))(E.vision_report)
register_evaluator("perplexity", ("logits", "label"))(E.perplexity)
register_evaluator("math", ("pred", "answer"), pred="pred", label="answer")(E.answer_accuracy)
register_evaluator("code", ("problem", "passed"), problem="problem", passed="passed")(E.pass_at_k_report)
register_evaluator("votes", ("name", "input_hash", "pred_hash", "q", "seq"))(E.vote_pass_report)
register_evaluator("caption", ("id", "pred", "ref"), keys=["id"], pred="pred", ref="ref")(E.bleu)


def evaluate(df: DataFrame, name: str, **params) -> DataFrame:
    """Run a registered evaluator; unknown names and missing columns fail before anything runs."""
    if name not in EVALUATORS:
        raise KeyError(f"no evaluator {name!r}; known are {sorted(EVALUATORS)}")
    return EVALUATORS[name](df, **params)


SOURCES: dict[str, Callable[..., DataFrame]] = {}
TRANSFORMS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_source(name: str):
    """A source reads ``(spark, path)`` into a sample table."""

    def add(reader):
        SOURCES[name] = reader
        return reader

    return add


def register_transform(name: str):
    """A transform maps a sample table to one; one row may become several."""

    def add(transform):
        TRANSFORMS[name] = transform
        return transform

    return add


def apply_transforms(df: DataFrame, names: list[str]) -> DataFrame:
    for name in names:
        df = TRANSFORMS[name](df)
    return df
