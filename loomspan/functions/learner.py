"""Learner models as column expressions: knowledge tracing, review scheduling, grading, experience points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Knowledge tracing, mastery, flow band, review scheduling, experience points.
P_INIT, P_LEARN, P_SLIP, P_GUESS = 0.0, 0.1, 0.1, 0.2
MASTERED = 0.95
FLOW_WINDOW, FLOW_LOW, FLOW_HIGH = 10, 0.70, 0.85
PASS_GRADE = 0.6
XP_PER_POINT, XP_PER_LEVEL = 10, 100
ORDERING_PASS = 0.999


def trace(p: Column, ok: Column) -> Column:
    """One knowledge-tracing step: the chance to learn comes first, then the evidence of the outcome."""
    learned = p + (1.0 - p) * P_LEARN
    right = learned * (1.0 - P_SLIP) / (learned * (1.0 - P_SLIP) + (1.0 - learned) * P_GUESS)
    wrong = learned * P_SLIP / (learned * P_SLIP + (1.0 - learned) * (1.0 - P_GUESS))
    return F.when(ok, right).otherwise(wrong)


def trace_history(outcomes: Column) -> Column:
    """Ordered outcomes to the mastery after each, as an array."""
    start = F.struct(F.lit(P_INIT).alias("p"), F.array().cast("array<double>").alias("seen"))

    def step(state: Column, ok: Column) -> Column:
        p = trace(state["p"], ok)
        return F.struct(p.alias("p"), F.array_append(state["seen"], p).alias("seen"))

    return F.aggregate(outcomes, start, step)["seen"]


def trace_last(outcomes: Column) -> Column:
    return F.aggregate(outcomes, F.lit(P_INIT), trace)


def stability_after(stability: Column, grade: Column) -> Column:
    """One review: a pass grows stability by the grade, a failure shrinks it to no less than 1."""
    return F.when(grade >= PASS_GRADE, stability * (1.0 + grade)).otherwise(F.greatest(F.lit(1.0), stability * grade))


def stability(grades: Column) -> Column:
    return F.aggregate(grades, F.lit(1.0), stability_after)


def interval(s: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(s, 0).cast("long"))


def xp(score: Column) -> Column:
    return F.bround(score * XP_PER_POINT, 0).cast("long")


def level(points: Column) -> Column:
    return F.lit(1).cast("long") + F.floor(points / XP_PER_LEVEL)


def fraction(score: Column, max_score: Column) -> Column:
    return F.when(max_score != 0, score / max_score).otherwise(F.lit(0.0))


def grade_choice(answer: Column, response: Column) -> Column:
    """Equality; a missing response fails."""
    return F.coalesce(answer.eqNullSafe(response), F.lit(False))


def grade_numeric(answer: Column, response: Column, tolerance: Column | None = None) -> Column:
    """Within an inclusive tolerance; by default a millionth of the answer, or 1e-9 where that is zero."""
    relative = F.abs(answer) * 1e-6
    given = F.when(relative != 0, relative).otherwise(F.lit(1e-9))
    return F.abs(response - answer) <= (given if tolerance is None else F.coalesce(tolerance, given))


def inversions(ranks: Column) -> Column:
    """Pairs of an array of distinct whole numbers that stand in descending order, by merging sorted runs.

    Runs double in length. Of two neighbouring runs, a number of the left one stands in the merged run as far behind its
    old place as the right one has smaller numbers, so the places tell the pairs without comparing them.
    """
    even, odd = lambda xs: F.transform(xs, lambda x: x * 2), lambda xs: F.transform(xs, lambda x: x * 2 + 1)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)

    def merged(run: Column, first: Column, length: Column) -> Column:
        return F.array_sort(F.concat(even(F.slice(run, first, length)), odd(F.slice(run, first + length, length))))

    def step(state: Column, level: Column) -> Column:
        length = F.pow(F.lit(2), level).cast("int")
        firsts = F.sequence(F.lit(1), F.size(state["run"]), length * 2)
        runs = F.transform(firsts, lambda first: merged(state["run"], first, length))
        # of each merged run the places of the left numbers, less the places that they had
        moved = lambda xs: total(F.transform(xs, lambda x, i: F.when(x % 2 == 0, i).otherwise(0).cast("long")))
        left = lambda xs: F.least(F.size(xs), length).cast("long")
        crossed = total(F.transform(runs, lambda xs: moved(xs) - F.floor(left(xs) * (left(xs) - 1) / 2)))
        return F.struct(F.transform(F.flatten(runs), lambda x: F.shiftright(x, 1)).alias("run"), (state["pairs"] + crossed).alias("pairs"))

    levels = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.size(ranks).cast("double"))).cast("int") - 1))
    start = F.struct(F.transform(ranks, lambda x: x.cast("long")).alias("run"), F.lit(0).cast("long").alias("pairs"))
    return F.aggregate(levels, start, step, lambda state: state["pairs"])


def ordering_fraction(answer: Column, response: Column) -> Column:
    """Normalised Kendall agreement of two orderings, compared as strings; 0 unless one permutes the other.

    The n-th occurrence of a value in the response stands for its n-th occurrence in the answer: sorted by value and
    place, both orderings have it at the same spot. Time grows as sorting does.
    """
    a, r = answer.cast("array<string>"), response.cast("array<string>")
    placed = lambda xs: F.array_sort(F.transform(xs, lambda x, i: F.struct(x.alias("value"), i.alias("place"))))
    met = F.array_sort(F.zip_with(placed(a), placed(r), lambda x, y: F.struct(x["place"].alias("a"), y["place"].alias("r"))))
    n = F.size(a).cast("long")
    same = F.array_sort(a) == F.array_sort(r)
    agreement = 1.0 - inversions(F.transform(met, lambda p: p["r"])) / (n * (n - 1) / 2)
    return F.when(~F.coalesce(same, F.lit(False)), F.lit(0.0)).when(n < 2, F.lit(1.0)).otherwise(agreement)


def grade(kind: Column, answer: Column, response: Column, tolerance: Column, max_score: Column) -> Column:
    """struct(score, success) of a check of any kind over VARIANT answer and response; an unknown kind raises."""
    text = lambda v: v.cast("string")
    part = ordering_fraction(F.try_variant_get(answer, "$", "array<string>"), F.try_variant_get(response, "$", "array<string>"))
    number = grade_numeric(F.try_variant_get(answer, "$", "double"), F.try_variant_get(response, "$", "double"), tolerance)
    chosen = grade_choice(text(answer), text(response))
    whole = lambda ok: F.when(ok, max_score.cast("double")).otherwise(F.lit(0.0))
    result = lambda score, ok: F.struct(score.cast("double").alias("score"), F.coalesce(ok, F.lit(False)).alias("success"))
    unknown = F.raise_error(F.concat(F.lit("unknown check kind: "), kind))
    return (
        F.when(kind == "choice", result(whole(chosen), chosen))
        .when(kind == "numeric", result(whole(number), number))
        .when(kind == "ordering", result(F.bround(max_score * part, 4), part >= ORDERING_PASS))
        .otherwise(unknown.cast("struct<score: double, success: boolean>"))
    )
