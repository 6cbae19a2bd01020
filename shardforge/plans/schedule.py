"""Step schedule of the guided sampler as a DataFrame (B1).

One row per sample and step. The grid is linspace(t0, t1, n) followed by 0:
n-1 noisy steps and one deterministic final step, all computed from the
step index (no join against a step table, no window)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from shardforge import constants as K


def t_at(i: Column, n: int, t0: float = K.T_START, t1: float = K.T_END) -> Column:
    """Grid value for step index ``i`` (0..n); index n is the final 0."""
    delta = (t1 - t0) / (n - 1)
    return (F.when(i >= F.lit(n), F.lit(0.0))
            .when(i == F.lit(n - 1), F.lit(float(t1)))
            .otherwise(F.lit(float(t0)) + i.cast("double") * F.lit(delta)))


def guided_flag(t_cur: Column, cfg: float, low: float, high: float) -> Column:
    """Closed interval test on t (rounded to 9 places so that both engines
    agree on a boundary value)."""
    t = F.round(t_cur, 9)
    return F.lit(cfg > 1.0) & (t >= F.lit(float(low))) & (t <= F.lit(float(high)))


def step_plan(samples: DataFrame, n: int, id_col: str = "sample_id", t0: float = K.T_START,
              t1: float = K.T_END, cfg: float = K.CFG_SCALE, low: float = K.GUIDANCE_LOW,
              high: float = K.GUIDANCE_HIGH,
              final_guidance: str = "always") -> DataFrame:
    if n < 2:
        raise ValueError("need at least 2 steps")
    if final_guidance not in ("always", "interval"):
        raise ValueError("final_guidance must be 'always' or 'interval'")
    step = F.col("step")
    t_cur = t_at(step, n, t0, t1)
    t_next = t_at(step + 1, n, t0, t1)
    is_final = step == F.lit(n - 1)
    g = F.lit(2.0) * F.col("t_cur")
    if final_guidance == "always":
        guided = F.when(is_final, F.lit(True)).otherwise(guided_flag(F.col("t_cur"), cfg, low, high))
    else:
        guided = guided_flag(F.col("t_cur"), cfg, low, high)
    return (samples.select(F.col(id_col).alias("sample_id"))
            .select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("step"))
            .withColumn("t_cur", t_cur)
            .withColumn("t_next", t_next)
            .withColumn("dt", F.col("t_next") - F.col("t_cur"))
            .withColumn("g", g)
            .withColumn("is_final", is_final)
            .withColumn("noise_scale", F.when(F.col("is_final"), F.lit(0.0))
                        .otherwise(F.sqrt(F.col("g")) * F.sqrt(F.abs(F.col("dt")))))
            .withColumn("guided", guided)
            .withColumn("model_rows", F.when(F.col("guided"), F.lit(2)).otherwise(F.lit(1))))


def step_cost(steps: DataFrame) -> DataFrame:
    """Model rows by guided flag, with the grand total (guided = NULL)."""
    return (steps.rollup("guided")
            .agg(F.count(F.lit(1)).alias("n_steps"),
                 F.sum("model_rows").cast("bigint").alias("model_rows")))


def schedule_array(n: int, t0: float = K.T_START, t1: float = K.T_END) -> list[float]:
    """The grid as a driver list (n + 1 values); a tiny constant."""
    delta = (t1 - t0) / (n - 1)
    return [t0 + i * delta for i in range(n - 1)] + [t1, 0.0]
