"""Expressions over one row's score vector (``array<double>``, index = class id)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_SCORE = float("-inf")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def computed_once(**columns: Column) -> Column:
    """Generator that adds ``columns`` to a row, each evaluated exactly once.

    A filter or join key on a projected column is pushed below the projection
    with the expression copied into it, as is the null check a join adds; for
    array lambdas or JSON parsing that repeats the costly part of a row. Nothing
    is pushed below a generator's output.
    """
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    """Softmax of ``logits / temperature``; a score of minus infinity gives 0."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))

    def normalise(exps: Column) -> Column:
        total = F.aggregate(exps, F.lit(0.0), lambda a, e: a + e)
        return let(total, lambda s: F.transform(exps, lambda e: e / s))

    def shifted(scaled: Column) -> Column:
        top = F.array_max(scaled)
        exps = let(top, lambda m: F.transform(scaled, lambda z: F.exp(z - m)))
        return let(exps, normalise)

    return let(F.transform(logits, lambda z: z / t), shifted)


def argmax(scores: Column) -> Column:
    """Index of the largest score; the lowest index wins ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def confidence(probs: Column) -> Column:
    return F.array_max(probs)


def top_k(probs: Column, k: int) -> Column:
    """The k best classes as ``array<struct<label_id, p>>``, best first.

    Ties go to the lower class id; k beyond the class count is cut down to it.
    """
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")
    ranked = F.array_sort(
        F.transform(probs, lambda p, i: F.struct((-p).alias("neg"), i.alias("label_id")))
    )
    return F.transform(
        F.slice(ranked, 1, k),
        lambda r: F.struct(r["label_id"].alias("label_id"), (-r["neg"]).alias("p")),
    )


def one_hot(class_id: Column, n_classes: int) -> Column:
    """1.0 at ``class_id``; a negative id (unknown) spreads evenly over all classes."""
    ids = F.sequence(F.lit(0), F.lit(n_classes - 1))
    spread = F.array_repeat(F.lit(1.0 / n_classes), n_classes)
    hot = F.transform(ids, lambda i: F.when(i == class_id, 1.0).otherwise(0.0))
    return F.when(class_id >= 0, hot).otherwise(spread)


def project_classes(scores: Column, seen_ids: Column, n_classes: int) -> Column:
    """Scores of the classes a model was trained on, placed on the full class list.

    ``seen_ids[i]`` is the class of ``scores[i]``. Classes the model never saw
    get minus infinity, hence probability 0.
    """
    by_class = F.map_from_arrays(seen_ids, scores)
    ids = F.sequence(F.lit(0), F.lit(n_classes - 1))
    return F.transform(
        ids, lambda i: F.coalesce(F.try_element_at(by_class, i), F.lit(NO_SCORE))
    )


# Far enough below any score for its weight to be 0, near enough for its square
# to be finite: a score of minus infinity itself would give 0 * infinity.
_FLOOR = -1e150


def shifted_scores(logits: Column) -> Column:
    """Scores minus the row's largest, which is all a softmax depends on."""
    return let(
        F.array_max(logits),
        lambda top: F.transform(logits, lambda z: F.greatest(z - top, F.lit(_FLOOR))),
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def log_loss(logits: Column, label: Column, temperature: float = 1.0) -> Column:
    """Negative log likelihood of ``label`` under ``softmax(logits / temperature)``."""
    beta = 1.0 / float(temperature)
    return let(
        shifted_scores(logits),
        lambda d: F.ln(_total(F.transform(d, lambda x: F.exp(x * beta))))
        - F.element_at(d, label + 1) * beta,
    )


def loss_derivatives(shifted: Column, label: Column, beta: Column) -> Column:
    """``struct<slope, curvature>`` of one row's loss at inverse temperature ``beta``.

    The sums run over plain double arrays: array lambdas are interpreted, and
    one that builds a struct per element costs several times as much.
    """

    def moments(weights: Column) -> Column:
        first = F.zip_with(weights, shifted, lambda w, d: w * d)

        def finish(m: Column) -> Column:
            mean = m["s1"] / m["s0"]
            return F.struct(
                (mean - F.element_at(shifted, label + 1)).alias("slope"),
                (m["s2"] / m["s0"] - mean * mean).alias("curvature"),
            )

        return let(
            let(
                first,
                lambda f: F.struct(
                    _total(weights).alias("s0"),
                    _total(f).alias("s1"),
                    _total(F.zip_with(f, shifted, lambda a, d: a * d)).alias("s2"),
                ),
            ),
            finish,
        )

    return let(F.transform(shifted, lambda d: F.exp(d * beta)), moments)
