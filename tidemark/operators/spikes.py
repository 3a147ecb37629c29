"""Implausible readings: impossible values, spikes and stuck values, per source against its own normal behaviour."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clean import number
from tidemark.functions.prefix import exact_median, running
from tidemark.operators.bars_data import current_bars
from tidemark.session import cut


@dataclass(frozen=True)
class SpikeRule:
    """What counts, and the filter that searches for it.

    moves: typical moves by which a spike leaves and returns; width: readings that a spike lasts at most; stuck: equal
    readings in a row from which a value counts as stuck; calm: share of repeated readings from which repeats are normal.
    threshold: standardised innovations from which the filter withholds an update; state and noise: standard deviations of
    a step and of a reading, in typical moves; vanish: root mean square of the last three innovations, in typical moves,
    under which their variance has vanished. threshold * (sqrt(state^2 + 2 noise^2) + noise) must stay under moves: then a
    reading that leaves an accepted one by `moves` typical moves is always flagged. stuck must be at least `settling`: then the
    innovations' variance has vanished before a run of that length ends.
    """

    moves: float = 10.0
    width: int = 3
    stuck: int = 8
    calm: float = 0.2
    threshold: float = 4.0
    state: float = 1.5
    noise: float = 0.3
    vanish: float = 0.05

    def __post_init__(self) -> None:
        if self.threshold * ((self.state**2 + 2 * self.noise**2) ** 0.5 + self.noise) >= self.moves:
            raise ValueError("the filter would overlook spikes of the given moves")
        if self.stuck < self.settling:
            raise ValueError(f"the filter would overlook runs of less than {self.settling} equal readings")

    @property
    def settling(self) -> int:
        """Equal readings after which the variance has vanished at the latest: the first `width` may be withheld, the next is
        taken with an innovation under the threshold, and each one after it leaves at most noise^2 / (state^2 + noise^2) of
        the innovation before, until three in a row are small enough. A new level instead settles two readings later."""
        q, r = self.state**2, self.noise**2
        e = self.threshold * ((self.width + 1) * q + 2 * r) ** 0.5  # the forecast variance grew while updates were withheld
        keep, n = r / (q + r), self.width + 3
        while e * e * (1 + keep**2 + keep**4) > 3 * self.vanish**2:
            e, n = e * keep, n + 1
        return n


def kalman_flags(x: np.ndarray, m: float, rule: SpikeRule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local-level filter over log readings x with typical move m: (flagged, vanished, standardised innovations).

    The level starts at the first reading, which counts as flagged since its innovation is unknown. A flagged reading's
    update is withheld, so the forecast variance grows; after rule.width flagged readings in a row the next flagged one is
    taken as a new level.
    """
    n = len(x)
    flagged, vanished, z = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n)
    if not n:
        return flagged, vanished, z
    q, r, lim, eps = (rule.state * m) ** 2, (rule.noise * m) ** 2, rule.threshold**2, 3 * (rule.vanish * m) ** 2
    values = x.tolist()
    level, var, held, e1, e2 = values[0], r, 0, 0.0, 0.0
    flagged[0] = vanished[0] = True
    for i in range(1, n):
        var += q
        s, e = var + r, values[i] - level
        ee = e * e
        z[i] = e / s**0.5 if s > 0 else 0.0
        if ee >= lim * s:
            flagged[i] = True
            held += 1
            if held > rule.width:
                level, var, held, ee = values[i], r, 0, 0.0
        else:
            held = 0
            gain = var / s if s > 0 else 1.0
            level += gain * e
            var *= 1 - gain
        vanished[i] = ee + e1 + e2 <= eps
        e1, e2 = ee, e1
    return flagged, vanished, z


def is_excursion(x: np.ndarray, m: float, rule: SpikeRule) -> np.ndarray:
    """The exact rule: readings of groups of at most rule.width that differ by rule.moves typical moves from both neighbours."""
    n, out, far = len(x), np.zeros(len(x), bool), rule.moves * m
    for width in range(1, rule.width + 1):
        starts = n - width - 1  # groups [s+1, s+width] between s and s+width+1
        if starts <= 0:
            break
        ok = np.ones(starts, bool)
        for j in range(1, width + 1):
            mid = x[j : j + starts]
            ok &= (np.abs(mid - x[:starts]) >= far) & (np.abs(mid - x[width + 1 :]) >= far)
        for j in range(1, width + 1):
            out[j : j + starts] |= ok
    return out


def scan_block(block: pa.Table, rule: SpikeRule) -> pa.Table:
    """One block of positive readings of one source with some readings of its neighbours at either end; the found ones of
    its own. Arrow in and out: keys never become Python objects."""
    block = block.take(pa.array(np.argsort(block["k"].to_numpy())))
    x, m = np.log(block["v"].to_numpy()), block["m"][0].as_py()
    if m is None:
        flagged, vanished, z = np.zeros(len(x), bool), np.zeros(len(x), bool), np.zeros(len(x))
        spike = flagged
    else:
        flagged, vanished, z = kalman_flags(x, m, rule)
        near = flagged.copy()  # a spike's own readings follow its flag, or the flag of the reading before it
        for d in range(1, rule.width + 1):
            near[d:] |= flagged[:-d]
        spike = near & is_excursion(x, m, rule)
    keep = pa.array((spike | vanished) & block["own"].to_numpy())
    out = block.select(["source", "field", "pos", "run"])
    for name, values in (("spike", spike), ("vanished", vanished), ("z", z)):
        out = out.append_column(name, pa.array(values))
    return out.filter(keep)


def find_implausible(readings: DataFrame, rule: SpikeRule = SpikeRule(), block: int = 4096) -> DataFrame:
    """(source, field, pos, kind, z) of each implausible reading of readings (source, field, pos, v).

    kind: 'impossible' (v <= 0), 'spike' or 'stuck' (a reading can be more than one); z is the standardised innovation at
    a spike. Missing v are skipped; pos is unique within (source, field) and orders it. A local-level Kalman filter per
    source, scaled by the source's typical move, flags innovations above the threshold, withholds their updates, and
    finds where the innovations' variance vanishes; an exact check of the flagged places follows. By the bounds in
    SpikeRule the filter overlooks no reading that the exact rule would take: if the reading before a spike was accepted,
    the spike's first reading is flagged, and otherwise that reading is. A source whose typical move is 0 has every
    reading searched; with less than two positive readings it has no spikes.

    Scale: running counts number the readings in blocks (functions.prefix), the filter runs in blocks of `block` positive
    readings with a halo, so a source with a third of all rows is many bounded tasks. The typical move is an exact
    distributed median.
    """
    keys = ["source", "field"]
    r = readings.select(*keys, "pos", number("v").alias("v")).where("v is not null").withColumn("b", F.floor(F.col("pos") / block))
    positive = F.when(F.col("v") > 0, F.col("v"))
    r = running(r, keys, "b", ["pos"], {"n": ("sum", F.lit(1)), "k": ("sum", F.when(F.col("v") > 0, 1).otherwise(0)), "before": ("prev", F.col("v")), "before_pos": ("prev", positive)})
    same = F.col("v").eqNullSafe(F.col("before"))
    r = r.withColumns({"same": same, "move": F.when(F.col("v") > 0, F.abs(F.ln("v") - F.ln("before_pos")))}).drop("before", "before_pos")
    r = cut(running(r, keys, "b", ["pos"], {"run": ("last", F.when(~F.col("same"), F.col("n")))}))

    m = exact_median(r, keys, "move", "m")
    normal = r.groupBy(*keys).agg(F.sum(F.col("same").cast("int")).alias("repeats"), F.count(F.lit(1)).alias("total")).join(m, keys, "left")

    halo = rule.width + 1
    kb, at = F.floor(F.col("k") / block), F.col("k") % block
    homes = F.array_compact(F.array(kb, F.when(at < halo, kb - 1), F.when(at >= block - halo, kb + 1)))
    pos = r.where("v > 0").join(normal.select(*keys, "m"), keys).select(*keys, "pos", "run", "k", "v", "m", kb.alias("home"), F.explode(homes).alias("kb"))
    pos = pos.withColumn("own", F.col("home") == F.col("kb"))
    found = pos.groupBy(*keys, "kb").applyInArrow(lambda table: scan_block(table, rule), "source string, field string, pos bigint, run bigint, spike boolean, vanished boolean, z double")
    found = cut(found)

    long_runs = r.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("len")).where(F.col("len") >= rule.stuck)
    long_runs = long_runs.join(normal.where(F.col("repeats") < F.lit(rule.calm) * F.col("total")), keys, "left_semi")
    stuck_runs = long_runs.join(found.where("vanished").select(*keys, "run").distinct(), [*keys, "run"], "left_semi")
    none = F.lit(None).cast("double")
    bad = r.where("v <= 0").select(*keys, F.col("pos").cast("bigint").alias("pos"), F.lit("impossible").alias("kind"), none.alias("z"))
    spikes = found.where("spike").select(*keys, "pos", F.lit("spike").alias("kind"), "z")
    stuck = r.join(stuck_runs, [*keys, "run"], "left_semi").select(*keys, F.col("pos").cast("bigint").alias("pos"), F.lit("stuck").alias("kind"), none.alias("z"))
    return bad.unionByName(spikes).unionByName(stuck)


def implausible_prices(etf: DataFrame, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """(asset, bar, field, kind, z) over the closes and opens of the current bars. Runs of equal impossible readings are
    already impossible; stuck runs are sought among the positive ones."""
    bars = current_bars(etf, ["open", "close"])
    one = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in ("close", "open"))))
    readings = bars.select(F.col("asset").alias("source"), F.col("bar").cast("bigint").alias("pos"), one.alias("o")).select("source", "pos", "o.field", "o.v")
    out = find_implausible(readings, rule)
    return out.select(F.col("source").alias("asset"), F.col("pos").cast("int").alias("bar"), "field", "kind", "z")
