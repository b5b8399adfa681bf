"""Metric-series queries (R1-R8, S8, A13, W5) on ``run_metrics`` / ``batch_losses``."""

from __future__ import annotations

from ..operators import metrics as M
from ..sources import adapters as A
from .catalog import register

SERIES = {"ls": """select run_id, 'train' as series, epoch, train_loss as loss from run_metrics
                   union all
                   select run_id, 'val' as series, epoch, val_loss as loss from run_metrics where val_loss is not null"""}


def _rm(spark, sf):
    return A.run_metrics(spark, sf)


def xavg(e: str, over: str = "") -> str:
    """Mean with an exact decimal sum (order-independent), as ``stats.exact_avg``."""
    return f"(cast(sum(cast({e} as decimal(38, 10))) {over} as double) / count({e}) {over})"


def _avg_frame(k: int) -> str:
    return xavg("loss", f"over (partition by run_id, series order by epoch rows between {k - 1} preceding and current row)")


@register("loss_moving_avg", A.with_views(f"""
select run_id, series, epoch, w as window,
       round(case w when 1 then a1 when 2 then a2 when 3 then a3 when 4 then a4 else a5 end, 6) as smoothed
from (select *, {_avg_frame(1)} as a1, {_avg_frame(2)} as a2, {_avg_frame(3)} as a3, {_avg_frame(4)} as a4,
             {_avg_frame(5)} as a5,
             row_number() over (partition by run_id, series order by epoch) as i,
             case when series = 'train' and n > 5 then least(5, n // 3)
                  when series = 'val' and n > 3 then least(3, n // 2) else 1 end as w
      from (select *, count(*) over (partition by run_id, series) as n from ls) t) t2
where i >= w""", "run_metrics", extra=SERIES))
def loss_moving_avg(spark, sf):
    return M.moving_average(_rm(spark, sf))


@register("loss_improvement", A.with_views("""
select run_id, series, epoch,
       round((first_value(loss) over (partition by run_id, series order by epoch) - loss)
             / first_value(loss) over (partition by run_id, series order by epoch) * 100.0e0, 6) as improvement_pct
from ls""", "run_metrics", extra=SERIES))
def loss_improvement(spark, sf):
    return M.improvement(_rm(spark, sf))


@register("best_epoch", A.with_views("""
select run_id, epoch, train_loss,
       min(train_loss) over (partition by run_id order by epoch rows between unbounded preceding and current row) as best_train_so_far,
       val_loss,
       min(val_loss) over (partition by run_id order by epoch rows between unbounded preceding and current row) as best_val_so_far,
       val_loss is not null and (pb is null or val_loss < pb) as new_best
from (select *, min(val_loss) over (partition by run_id order by epoch rows between unbounded preceding and 1 preceding) as pb
      from run_metrics) t""", "run_metrics"))
def best_epoch(spark, sf):
    return M.best_epochs(_rm(spark, sf))


@register("early_stop_point", A.with_views("""
select run_id, 5 as patience, min(case when counter >= 5 then epoch end) as stop_epoch,
       arg_min(epoch, (val_loss, epoch)) as best_epoch, min(val_loss) as best_val_loss
from (select *, k - max(case when new_best then k end) over (partition by run_id order by epoch
                                                          rows between unbounded preceding and current row) as counter
      from (select *, row_number() over (partition by run_id order by epoch) as k,
                   val_loss < coalesce(min(val_loss) over (partition by run_id order by epoch
                                               rows between unbounded preceding and 1 preceding), 'inf'::double) as new_best
            from run_metrics where val_loss is not null) t) t2
group by run_id""", "run_metrics"))
def early_stop_point(spark, sf):
    return M.early_stop(_rm(spark, sf))


@register("loss_trend", A.with_views("""
select run_id, round((arg_max(train_loss, epoch) - arg_min(train_loss, epoch)) / 2.0e0, 6) as slope,
       case when abs((arg_max(train_loss, epoch) - arg_min(train_loss, epoch)) / 2.0e0) < 0.001e0 then 'converged'
            when (arg_max(train_loss, epoch) - arg_min(train_loss, epoch)) / 2.0e0 < 0 then 'improving'
            else 'difficulty' end as trend
from (select *, row_number() over (partition by run_id order by epoch desc) as r from run_metrics) t
where r <= 3 group by run_id having count(*) >= 3""", "run_metrics"))
def loss_trend(spark, sf):
    return M.trend(_rm(spark, sf))


@register("overfit_flag", A.with_views(f"""
select run_id, round(rt, 6) as recent_train, round(rv, 6) as recent_val,
       case when not (nt > 3 and nv > 3) then 'insufficient' when rv > rt * 1.2e0 then 'overfit'
            when rv < rt * 1.1e0 then 'good' else 'neutral' end as flag
from (select run_id, {xavg("case when series = 'train' and r <= 3 then loss end")} as rt,
             {xavg("case when series = 'val' and r <= 3 then loss end")} as rv,
             max(case when series = 'train' then n end) as nt, max(case when series = 'val' then n end) as nv
      from (select *, row_number() over (partition by run_id, series order by epoch desc) as r,
                   count(*) over (partition by run_id, series) as n from ls) t
      group by run_id) t2""", "run_metrics", extra=SERIES))
def overfit_flag(spark, sf):
    return M.overfit(_rm(spark, sf))


@register("loss_histogram", A.with_views("""
select g.run_id, g.series, g.bin, round(g.lo + g.bin * g.wd, 6) as bin_lo, round(g.lo + (g.bin + 1) * g.wd, 6) as bin_hi,
       cast(coalesce(c.cnt, 0) as bigint) as cnt, round(coalesce(c.cnt, 0) / (g.n * g.wd), 6) as density
from (select run_id, series, n, lo, wd, unnest(range(0, bins)) as bin from st) g
left join (select ls.run_id, ls.series, least(cast(floor((ls.loss - st.lo) / st.wd) as integer), st.bins - 1) as bin,
                  count(*) as cnt
           from ls join st on ls.run_id = st.run_id and ls.series = st.series group by all) c
  on c.run_id = g.run_id and c.series = g.series and c.bin = g.bin""", "run_metrics", extra={**SERIES, "st": """
select run_id, series, n, bins, lo, hi, (hi - lo) / bins as wd from (
  select run_id, series, count(*) as n, case when series = 'train' then 20 else 15 end as bins,
         case when max(loss) > min(loss) then min(loss) else min(loss) - 0.5e0 end as lo,
         case when max(loss) > min(loss) then max(loss) else max(loss) + 0.5e0 end as hi
  from ls group by run_id, series) t"""}))
def loss_histogram(spark, sf):
    return M.histogram(_rm(spark, sf))


@register("epoch_loss", A.with_views(f"""
select run_id, epoch, count(*) as n_batches, round({xavg("loss")}, 6) as epoch_loss
from batch_losses group by run_id, epoch""", "batch_losses"))
def epoch_loss(spark, sf):
    return M.epoch_loss(A.batch_losses(spark, sf))


@register("running_loss", A.with_views("""
select run_id, epoch, batch,
       round(cast(sum(cast(loss as decimal(38, 10))) over w as double) / count(*) over w, 6) as running_loss
from batch_losses
window w as (partition by run_id, epoch order by batch rows between unbounded preceding and current row)""",
                                       "batch_losses"))
def running_loss(spark, sf):
    return M.running_loss(A.batch_losses(spark, sf))


@register("run_summary", A.with_views("""
select run_id, count(*) as epochs, arg_max(train_loss, epoch) as final_train_loss, min(train_loss) as best_train_loss,
       arg_max(val_loss, epoch) filter (where val_loss is not null) as final_val_loss, min(val_loss) as best_val_loss,
       arg_min(epoch, (val_loss, epoch)) filter (where val_loss is not null) as best_val_epoch,
       sum(secs) as total_secs,
       format('{}h {}m {}s', cast(floor(sum(secs)) as bigint) // 3600, (cast(floor(sum(secs)) as bigint) % 3600) // 60,
              cast(floor(sum(secs)) as bigint) % 60) as elapsed,
       case when count(*) > 1 then round((arg_min(train_loss, epoch) - arg_max(train_loss, epoch))
                                         / arg_min(train_loss, epoch) * 100.0e0, 6) end as improvement_pct
from run_metrics group by run_id""", "run_metrics"))
def run_summary(spark, sf):
    return M.run_summary(_rm(spark, sf))
