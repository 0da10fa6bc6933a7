"""Weighted memberships that hold for a time: closed windows [valid_from, valid_to]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import code, finite, first_code, one_of
from ..functions.intervals import closed
from .sequence import stored_before
from .sweeps import running, stabbed

#: The roles.
ROLES = ("author", "department", "organization", "customer", "partner", "competitor", "project", "opportunity_pool", "template", "language", "location", "episode")


def assignment_error(weight: str = "weight", role: str = "role") -> Column:
    f, t = F.col("valid_from"), F.col("valid_to")
    return first_code(
        code(~one_of(F.col(role), ROLES), "UnknownMembershipRole"),
        code(f.isNull() | t.isNull() | (f >= t), "InvalidMembershipValidity"),
        code(~finite(F.col(weight)) | (F.col(weight) < 0), "InvalidMembershipWeight"),
    )


def stored_error(weight: str = "weight") -> Column:
    """What storage asks beyond: a weight over 0, one member column of three and one group column."""
    members = sum(F.col(c).isNotNull().cast("int") for c in ("document_id", "segment_id", "mention_id"))
    groups = sum(F.col(c).isNotNull().cast("int") for c in ("entity_id", "project_id"))
    return first_code(code(members != 1, "AmbiguousMember"), code(groups != 1, "AmbiguousGroup"), code(~finite(F.col(weight)) | (F.col(weight) <= 0), "InvalidMembershipWeight"))


def network_error(assignments: DataFrame, seq: str | None = None) -> DataFrame:
    """DuplicateMembership where an earlier row (by `seq`) has the same (member, group, role), whatever the windows."""
    again = stored_before(assignments, ["member_id", "group_id", "role"], F.lit(True), seq)
    return assignments.withColumn("error_code", code(again, "DuplicateMembership"))


def by_document(assignments: DataFrame, document: str) -> DataFrame:
    return assignments.where(F.col("document_id") == document).orderBy("membership_id")


def active_at(assignments: DataFrame, at: Column) -> DataFrame:
    return assignments.where(closed(F.col("valid_from"), F.col("valid_to"), at))


def active_for(assignments: DataFrame, moments: DataFrame, member: str = "member_id", at: str = "at") -> DataFrame:
    """For (member, at) rows the assignments active then: windows and moments meet in the slabs of time that hold both, so a busy member's rows aren't paired with all its moments."""
    return stabbed(assignments, moments.select(F.col(member), F.col(at)), member, "valid_from", "valid_to", at, closed=True)


def _counted(windows: DataFrame, keys: list[str], moments: DataFrame, at: str, deltas: dict[str, Column]) -> DataFrame:
    """`moments` (keys, at) with sums of `deltas` over the windows that hold each: added at a window's start, taken off behind its end."""
    starts = windows.select(*keys, F.col("valid_from").alias(at), F.lit(0).alias("__kind"), *[d.alias(n) for n, d in deltas.items()])
    ends = windows.select(*keys, F.col("valid_to").alias(at), F.lit(2).alias("__kind"), *[(-d).alias(n) for n, d in deltas.items()])
    asked = moments.select(*keys, at, F.lit(1).alias("__kind"), *[F.lit(0).cast(windows.select(d.alias(n)).schema[n].dataType).alias(n) for n, d in deltas.items()])
    steps = starts.unionByName(ends).unionByName(asked).withColumn("__id", F.monotonically_increasing_id())
    line = running(steps, keys, [at, "__kind", "__id"], {n: ("sum", F.col(n)) for n in deltas})
    return line.where("__kind = 1").drop("__kind", "__id")


def merged_windows(assignments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, valid_from, valid_to): the closed windows of the same keys that overlap or touch at an instant, made one."""
    own = assignments.where("valid_from <= valid_to").select(*keys, "valid_from", "valid_to").withColumn("__id", F.monotonically_increasing_id())
    reach = _reached(own, keys)
    fresh = F.col("__reach").isNull() | (F.col("valid_from") > F.col("__reach"))
    island = running(reach.withColumn("__fresh", fresh.cast("long")), keys, ["valid_from", "__id"], {"__island": ("sum", F.col("__fresh"))})
    return island.groupBy(*keys, "__island").agg(F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to")).drop("__island")


def _reached(windows: DataFrame, keys: list[str]) -> DataFrame:
    """`windows` (with __id) and __reach, the latest end of the windows of the same keys before each."""
    # a window's end counts from behind its own row on
    twice = windows.withColumn("__turn", F.explode(F.array(F.lit(0), F.lit(1))))
    line = running(twice, keys, ["valid_from", "__id", "__turn"], {"__reach": ("max", F.when(F.col("__turn") == 1, F.col("valid_to")))})
    return line.where("__turn = 0").drop("__turn")


def multiplicity_at(assignments: DataFrame, moments: DataFrame, member: str = "member_id", at: str = "at") -> DataFrame:
    """(member, at, multiplicity): in how many groups a member is at each of any number of moments; 0 where in none, repeated moments answered each.

    A step function: windows of one group are merged, each is +1 at its start
    and -1 behind its end, and sums run along the member's time.
    """
    own = merged_windows(assignments, [member, "group_id"])
    return _counted(own, [member], moments.select(member, at), at, {"multiplicity": F.lit(1).cast("long")})


def weight_by_role_at(assignments: DataFrame, moments: DataFrame, member: str = "member_id", at: str = "at", scale: int = 6) -> DataFrame:
    """(member, role, at, weight): the summed weight of each role that a member has at a moment; moments count once, roles it doesn't have give no row.

    Weights are summed as decimals of `scale` digits behind the point, so that
    what is added at a window's start is taken off whole behind its end.
    """
    sound = assignments.where("valid_from <= valid_to")
    roles = sound.select(member, "role").distinct()
    asked = moments.select(member, at).distinct().join(roles, member)
    deltas = {"weight": F.col("weight").cast(f"decimal(28,{scale})"), "__held": F.lit(1).cast("long")}
    return _counted(sound, [member, "role"], asked, at, deltas).where("__held > 0").select(member, "role", at, F.col("weight").cast("double").alias("weight"))


def group_multiplicity(active: DataFrame) -> DataFrame:
    return active.groupBy("member_id").agg(F.count_distinct("group_id").alias("multiplicity"))


def weight_by_role(active: DataFrame) -> DataFrame:
    return active.groupBy("member_id", "role").agg(F.sum("weight").alias("weight"))


def _ess_error(w: Column) -> Column:
    """Over a group's rows: no rows, a weight that isn't finite or is below 0, or no mass."""
    bad = F.count_if(~finite(w) | (w < 0)) > 0
    return code((F.count(F.lit(1)) == 0) | bad | ~(F.sum(w) > 0), "InvalidMembershipWeight")


def kish(rows: DataFrame, *by: str, weight: str = "weight") -> DataFrame:
    """(by, ess, design_effect, error_code): Kish's effective sample size and n / ess, by groups or of all rows; failing closed."""
    w = F.col(weight)
    g = rows.groupBy(*by).agg(_ess_error(w).alias("error_code"), F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w)).alias("e"), F.count(F.lit(1)).alias("n"))
    ok = F.col("error_code").isNull()
    return g.select(*by, F.when(ok, F.col("e")).alias("ess"), F.when(ok, F.col("n") / F.col("e")).alias("design_effect"), "error_code")


def group_normalized_kish(rows: DataFrame, group: str = "group", weight: str = "weight") -> DataFrame:
    """One row (ess, error_code): weights as shares of their groups, then Kish over all; a group without mass is an error."""
    w = F.col(weight)
    # the shares of a group sum to 1, their squares to sum w^2 / (sum w)^2: no second pass over the rows
    g = rows.groupBy(group).agg(_ess_error(w).alias("bad"), (F.sum(w * w) / F.nullif(F.sum(w) * F.sum(w), F.lit(0).cast("double"))).alias("squares"))
    s = g.agg(F.count(F.lit(1)).alias("k"), F.sum("squares").alias("q"), F.count("bad").alias("bad"))
    error = code((F.col("k") == 0) | (F.col("bad") > 0), "InvalidMembershipWeight")
    return s.select(F.when(error.isNull(), F.col("k").cast("double") * F.col("k") / F.col("q")).alias("ess"), error.alias("error_code"))
