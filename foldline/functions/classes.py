"""Direction classes: labels, probabilities and the choice of a class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The classes in order, and in the order in which they win ties.
CLASSES = ("cut", "hold", "hike")
TIE_PRIORITY = ("hold", "cut", "hike")


def direction(action_bp: Column, width: float = 0.0) -> Column:
    """cut under -width, hike above width, hold between; null stays null."""
    return F.when(action_bp < -width, "cut").when(action_bp > width, "hike").when(action_bp.isNotNull(), "hold")


def class_index(label: Column) -> Column:
    """0, 1, 2 by class order; null for anything else."""
    position = F.array_position(F.array(*map(F.lit, CLASSES)), label)
    return F.when(position > 0, (position - 1).cast("int"))


def one_hot(label: Column) -> Column:
    return F.transform(F.array(*map(F.lit, CLASSES)), lambda c: (c == label).cast("int"))


def choose_class(*probabilities: Column) -> Column:
    """The class of the largest probability (given in class order); ties go hold, cut, hike."""
    of = dict(zip(CLASSES, probabilities, strict=True))
    ranked = [F.struct(of[c].alias("p"), F.lit(-k).alias("first"), F.lit(c).alias("label")) for k, c in enumerate(TIE_PRIORITY)]
    return F.greatest(*ranked)["label"]
