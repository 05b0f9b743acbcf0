"""Reminders, archiving, stage moves and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import elapsed_days, fold
from leadloom.operators.kpi import live
from leadloom.operators.scoring import window_rank

# Follow-up days by stage, and allowed moves.
SCHEDULES = {"novo": (1, 3), "contactado": (3, 7, 14), "negociacao": (2, 5, 10)}
TRANSITIONS = {
    "novo": ("contactado", "arquivado"), "contactado": ("negociacao", "perdido", "arquivado"), "negociacao": ("ganho", "perdido", "arquivado"),
    "ganho": ("arquivado",), "perdido": ("arquivado", "novo"), "arquivado": ("novo",),
}


def _now(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def mapped(label: Column, codes: dict[str, str], default: str) -> Column:
    """A label's code, without regard to case and outer white space."""
    pairs = [F.lit(x) for pair in codes.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(F.trim(label))), F.lit(default))


def recently_noted(notes: DataFrame, since: Column) -> DataFrame:
    return notes.where(F.col("created_at") >= since).select("lead_id").distinct()


def reminders(leads: DataFrame, notes: DataFrame, as_of: str, gap_days: int = 1, schedules: dict[str, Sequence[int]] = SCHEDULES) -> DataFrame:
    """Leads past a follow-up day of their stage, with the largest day passed, unless noted within the gap."""
    stage = fold(F.coalesce("crm_stage", F.lit("novo")))
    days = F.coalesce(*[F.when(stage == s, F.array(*map(F.lit, d))) for s, d in schedules.items()])
    idle = elapsed_days(F.coalesce("last_seen_at", "first_seen_at"), _now(as_of))
    due = live(leads).select("id", stage.alias("stage"), idle.alias("idle_days"), F.array_max(F.filter(days, lambda d: d <= idle)).alias("threshold"))
    due = due.where((F.col("idle_days") > 0) & F.col("threshold").isNotNull())
    seen = recently_noted(notes, _now(as_of) - F.expr(f"interval {gap_days} days"))
    return due.join(seen, F.col("id") == F.col("lead_id"), "left_anti")


def pending_per_stage(leads: DataFrame, notes: DataFrame, as_of: str, schedules: dict[str, Sequence[int]] = SCHEDULES) -> DataFrame:
    dim = leads.sparkSession.createDataFrame([(s,) for s in schedules], "stage string")
    return F.broadcast(dim).join(reminders(leads, notes, as_of, schedules=schedules).groupBy("stage").agg(F.count("*").alias("n")), "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))


def stale(leads: DataFrame, notes: DataFrame, as_of: str, days: int = 60, active: Sequence[str] = ("contactado", "negociacao")) -> DataFrame:
    """Idle leads with what happens to them: archived, or the first reason to keep them."""
    since = _now(as_of) - F.expr(f"interval {days} days")
    idle = live(leads).where((F.col("last_seen_at") < since) | F.col("last_seen_at").isNull())
    noted = recently_noted(notes, since).withColumn("noted", F.lit(True))
    outcome = F.when(fold(F.col("crm_stage")).isin(*active), "kept_active_stage").when(F.col("priority_flag"), "kept_priority").when(F.col("noted"), "kept_recent_note").otherwise("archived")
    return idle.join(noted, F.col("id") == F.col("lead_id"), "left").select("id", outcome.alias("outcome"))


def dropped(leads: DataFrame, statuses: DataFrame) -> DataFrame:
    """404 and 410 mark a listing as dropped, other codes below 400 as alive, the rest are errors."""
    kind = F.when(F.col("status").isin(404, 410), "dropped").when((F.col("status") >= 200) & (F.col("status") < 400), "alive").otherwise("error")
    return leads.join(statuses, "id").select("id", "status", kind.alias("outcome"))


def moves(requests: DataFrame, leads: DataFrame, transitions: dict[str, Sequence[str]] = TRANSITIONS) -> DataFrame:
    """Stage requests (lead_id, seq, to_stage) folded in order over each lead: final stage, accepted and refused moves."""
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, bs in transitions.items() for b in bs])
    listed = requests.groupBy("lead_id").agg(F.array_sort(F.collect_list(F.struct("seq", "to_stage"))).alias("r"))
    rows = leads.select(F.col("id").alias("lead_id"), fold(F.col("crm_stage")).alias("stage")).join(listed, "lead_id")
    start = F.struct(F.col("stage").alias("stage"), F.lit(0).alias("ok"), F.lit(0).alias("refused"))

    def step(acc: Column, x: Column) -> Column:
        fits = F.array_contains(allowed, F.concat(acc["stage"], F.lit(">"), x["to_stage"]))
        return F.struct(F.when(fits, x["to_stage"]).otherwise(acc["stage"]).alias("stage"), (acc["ok"] + fits.cast("int")).alias("ok"), (acc["refused"] + (~fits).cast("int")).alias("refused"))

    done = rows.select("lead_id", F.aggregate("r", start, step).alias("m"))
    return done.select("lead_id", F.col("m.stage").alias("stage"), F.col("m.ok").alias("accepted"), F.col("m.refused").alias("refused"), (F.col("m.stage") == "arquivado").alias("archived"))


def due_alerts(leads: DataFrame, alerts: DataFrame, as_of: str) -> DataFrame:
    """Hot leads without a successful alert of the day."""
    day = F.date_trunc("day", _now(as_of)).cast("timestamp_ntz")
    sent = alerts.where((F.col("sent_at") >= day) & F.col("success")).select("lead_id").distinct()
    return live(leads).where(F.col("score_label") == "HOT").join(sent, F.col("id") == F.col("lead_id"), "left_anti")


def without_demo(leads: DataFrame, children: DataFrame, key: str = "lead_id") -> DataFrame:
    """Rows of a child table whose lead isn't a demo lead."""
    return children.join(leads.where("is_demo").select(F.col("id").alias(key)), key, "left_anti")


def bulk_move(leads: DataFrame, ids: DataFrame, stage: str, transitions: dict[str, Sequence[str]] = TRANSITIONS) -> DataFrame:
    """The chosen leads with the stage they end in, and whether the move was allowed."""
    chosen = ids.select("id").distinct()
    allowed = fold(F.col("crm_stage")).isin(*[a for a, bs in transitions.items() if stage in bs])
    return leads.join(chosen, "id").select("id", F.when(allowed, stage).otherwise(fold(F.col("crm_stage"))).alias("stage"), F.coalesce(allowed, F.lit(False)).alias("moved"))


def latest_notes(notes: DataFrame, k: int = 3) -> DataFrame:
    """The newest notes of each lead, and their place."""
    return window_rank(notes, "lead_id", [F.desc("created_at"), F.desc("id")], k)


def bulk_update(leads: DataFrame, ids: DataFrame, priority: bool | None = None, archive: bool | None = None) -> DataFrame:
    chosen = ids.select("id").distinct().withColumn("chosen", F.lit(True))
    rows = leads.join(chosen, "id", "left")
    flag = lambda c, v: F.when(F.col("chosen"), v).otherwise(F.col(c)) if v is not None else F.col(c)
    return rows.select("id", flag("priority_flag", priority).alias("priority_flag"), flag("archived", archive).alias("archived"))


def promote(signals: DataFrame, leads: DataFrame) -> DataFrame:
    """Signals that aren't promoted and whose fingerprint no lead has, as new leads."""
    new = signals.where(~F.col("promoted")).join(leads.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return new.select("fingerprint", "zone", F.col("signal_score").alias("score"), F.when(F.col("signal_score") >= 50, "WARM").otherwise("COLD").alias("score_label"))
