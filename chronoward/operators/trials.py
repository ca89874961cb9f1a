"""Outcomes of breathing trials: onset variants, extubation, failure, withdrawal and success, row by row.

Everything but the two look-ups of other tables comes from windows over one entity, so the rows are shuffled once on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.localtime import minutes_between
from .asof import asof_join
from .machine import consensus_events
from .relational import parts_for
from .respiratory import trial_states
from .sequence import HOUR, event_within, islands, running

#: Modes that set the breathing rate, end-of-life discharges.
CONTROLLED_MODES = ("assist control-volume control", "pressure control", "pressure-regulated volume control", "simv")
END_OF_LIFE = ("hospice", "expired")
#: Rows of a task.
TASK_ROWS = 50_000

VARIANTS = ("sbt_done", "sbt_done_anyprior", "sbt_done_imv6h", "sbt_done_prefix", "sbt_done_multiday", "sbt_done_2min", "sbt_done_subira", "sbt_done_abc", "sbt_done_v2", "sbt_elig")
EXITS = ("_extub_1st", "_fail_extub", "_withdrawl_lst", "_success_extub")


def truth(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def row_events(df: DataFrame, by: str, order: Sequence) -> DataFrame:
    """Intubation, extubation and tracheostomy as changes from the row before, with the first of each kind marked."""
    w = Window.partitionBy(by).orderBy(*order)
    imv, was = F.col("device_category").eqNullSafe("imv"), F.lag("device_category").over(w)
    df = df.withColumns(
        {
            "_intub": truth(imv & ~was.eqNullSafe("imv")),
            "_extub": truth(~imv & (was == "imv")),
            "_trach_flip": truth((F.lag("tracheostomy").over(w) == 0) & (F.col("tracheostomy") == 1)),
            "_on_imv": imv.cast("int"),
            "_prior_mode_controlled": truth(F.lag("mode_category").over(w).isin(*CONTROLLED_MODES)),
        }
    )
    first = lambda flag: truth((F.col(flag) == 1) & (F.sum(flag).over(running([by], order)) == 1))
    return df.withColumns({"_extub_1st": first("_extub"), "_trach_1st": first("_trach_flip")})


def durations(df: DataFrame, by: str, time: str, order: Sequence) -> DataFrame:
    """Blocks of each state and their minutes: the primary ones end where the next begins, the others at their last row;
    and the minutes that the device has been invasive so far, here and on the row before."""
    df = islands(df, [by], order, {"_block": F.col("state_primary"), "_block_subira": F.col("state_broad"), "_block_abc": F.col("state_strict"), "_imv_streak": F.col("_on_imv")})
    df = df.withColumns({f"_lag_{n}": F.lag(n).over(Window.partitionBy(by).orderBy(*order)) for n in ("state_primary", "state_broad", "state_strict")})
    start = lambda block: F.min(time).over(Window.partitionBy(by, block))
    last = lambda block: F.max(time).over(Window.partitionBy(by, block))
    following = F.min(time).over(Window.partitionBy(by).orderBy("_block").rangeBetween(1, Window.unboundedFollowing))
    df = df.withColumns(
        {
            "_a": start("_block"), "_b": F.coalesce(following, last("_block")), "_a_subira": start("_block_subira"), "_b_subira": last("_block_subira"),
            "_a_abc": start("_block_abc"), "_b_abc": last("_block_abc"), "_a_imv": start("_imv_streak"),
            "_block_controlled": F.max("_prior_mode_controlled").over(Window.partitionBy(by, "_block")),
        }
    )
    df = df.withColumns({"_minutes": minutes_between(df, "_a", "_b"), "_minutes_subira": minutes_between(df, "_a_subira", "_b_subira"), "_minutes_abc": minutes_between(df, "_a_abc", "_b_abc")})
    df = df.withColumn("_imv_minutes", F.when(F.col("_on_imv") == 1, minutes_between(df, "_a_imv", time)))
    return df.withColumn("_lag_imv_minutes", F.lag("_imv_minutes").over(Window.partitionBy(by).orderBy(*order)))


def variants(df: DataFrame) -> DataFrame:
    """The eight definitions of a delivered trial, the later flip rule and eligibility, 0/1 each."""
    here, before, minutes = F.col("state_primary") == 1, F.col("_lag_state_primary") == 0, F.col("_minutes")
    controlled = F.col("_prior_mode_controlled") == 1
    stable = (F.coalesce("fio2_set", F.lit(999.0)) <= 0.5) & (F.coalesce("peep_set", F.lit(999.0)) <= 8)
    return df.withColumns(
        {
            "sbt_done": truth((minutes >= 30) & here & before & controlled),
            "sbt_done_anyprior": truth((minutes >= 30) & here & before),
            "sbt_done_imv6h": truth((minutes >= 30) & here & before & (F.col("_lag_imv_minutes") >= 360)),
            "sbt_done_prefix": truth((minutes >= 30) & here),
            "sbt_done_multiday": truth((minutes >= 30) & here & (F.col("_block_controlled") == 1)),
            "sbt_done_2min": truth((minutes >= 2) & here & before & controlled),
            "sbt_done_subira": truth((F.col("_minutes_subira") >= 30) & (F.col("state_broad") == 1) & (F.col("_lag_state_broad") == 0)),
            "sbt_done_abc": truth((F.col("_minutes_abc") >= 30) & (F.col("state_strict") == 1) & (F.col("_lag_state_strict") == 0)),
            "sbt_done_v2": truth((minutes >= 2) & here & before),
            "sbt_elig": truth((F.col("_imv_minutes") >= 360) & stable),
        }
    )


def trial_outcomes(
    df: DataFrame, by: str, time: str, code_status: DataFrame, discharges: DataFrame, tiebreak: Sequence[str] = (), reintubation_hours: int = 48, status_tiebreak: Sequence[str] = ()
) -> DataFrame:
    """`df` (filled respiratory rows, lower-case categories) with all trial and exit outcomes.

    `code_status` has the entity, start_dttm and code_status_category; `discharges` the entity, discharge_dttm and
    discharge_category. A failed extubation is an intubation strictly later and within the hours given. Columns ending in
    _v2 rest on confirmed events (`consensus_events`) instead of single rows. Rows after a tracheostomy leave, but the
    first of it.
    """
    order = [time, *tiebreak]
    parts = parts_for(df.sparkSession, df.count(), TASK_ROWS)  # a task holds its rows in each of about ten sorts
    rows = durations(row_events(trial_states(df.repartition(parts, by)), by, order), by, time, order)
    rows = variants(rows).withColumns({"_imv": F.col("_on_imv") == 1, "_trach": F.coalesce(F.col("tracheostomy") == 1, F.lit(False))})
    rows = consensus_events(rows, by, time, "_imv", "_trach", tiebreak=tiebreak)
    first = lambda flag: truth((F.col(flag) == 1) & (F.sum(flag).over(running([by], order)) == 1))
    rows = rows.withColumns({"_extub_1st_v2": first("_off_event"), "_trach_v2": first("_stop_event")})
    for name, event, suffix in (("_again", "_intub", ""), ("_again_v2", "_on_event", "_v2")):
        rows = event_within(rows, [by], time, F.col(event) == 1, reintubation_hours * HOUR, name)
        rows = rows.withColumn(f"_fail_extub{suffix}", truth((F.col(f"_extub_1st{suffix}") == 1) & (F.col(name) == 1)))
    rows = asof_join(rows, code_status, [by], time, "start_dttm", ["code_status_category"], tiebreak=status_tiebreak, parts=parts)
    rows = asof_join(rows, discharges, [by], time, "discharge_dttm", ["discharge_category"], direction="forward", parts=parts)
    limited = (F.trim(F.lower("code_status_category")) != "full") & F.trim(F.lower("discharge_category")).isin(*END_OF_LIFE)
    for suffix in ("", "_v2"):
        gone = F.col(f"_extub_1st{suffix}") == 1
        rows = rows.withColumn(f"_withdrawl_lst{suffix}", truth(gone & limited))
        rows = rows.withColumn(f"_success_extub{suffix}", truth(gone & (F.col(f"_withdrawl_lst{suffix}") == 0) & (F.col(f"_fail_extub{suffix}") == 0)))
    return rows.where("tracheostomy = 0 OR _trach_1st = 1 OR _trach_v2 = 1").select(*df.columns, *VARIANTS, *EXITS, *[f"{c}_v2" for c in EXITS], "_trach_1st", "_trach_v2", F.col("_minutes").alias("_block_minutes"), "code_status_category", "discharge_category")
