"""Ordered folds per key: recursive filters, gates and state machines.

A kernel is a pure step from (state, values, time) to (state, output or None);
the state is a short tuple.  ``fold`` runs it in batch over sorted partitions,
row by row with one state at a time, so a key of any length needs no memory;
``fold_stream`` runs the same step with Spark's state store.  A fold's key is
the unit that machines can share; the order within it is the operator.

In all kernels a row whose time or one of whose values is null or NaN leaves the
state as it is and gives nothing.  A null key is a key like others.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

State = tuple

# Fixed values of the state machines.
MOTION_STEPS = (0.04, 0.12, 0.25)
MOTION_CLASSES = ("absent", "present_still", "present_moving", "active")
ACTIONS, ACTION_EDGES = ("accept", "predict_only", "reject", "recalibrate"), (0.5, 0.7, 0.9)


@dataclass(frozen=True)
class Kernel:
    """``step(state, values, t)`` gives (state, outputs or None); ``output`` names the outputs' types.

    A row with a missing value leaves the state alone, but for the values numbered
    in ``optional``, which reach the step as None or NaN.
    """

    start: State
    step: Callable[[State, tuple, float], tuple[State, tuple | None]]
    output: str
    optional: tuple[int, ...] = ()


def ema(alpha: float = 0.15) -> Kernel:
    """Exponential mean, started at the first value."""

    def step(s: State, v: tuple, t: float):
        mean = v[0] if s[0] is None else s[0] * (1 - alpha) + v[0] * alpha
        return (mean,), (mean,)

    return Kernel((None,), step, "ema double")


def cusum(target: float, drift: float, limit: float) -> Kernel:
    """Two-sided cumulative sums; both start anew after an alarm (1 up, -1 down)."""

    def step(s: State, v: tuple, t: float):
        up, down = max(0.0, s[0] + v[0] - target - drift), max(0.0, s[1] - v[0] + target - drift)
        alarm = 1 if up > limit else -1 if down > limit else 0
        return ((0.0, 0.0) if alarm else (up, down)), (up, down, alarm)

    return Kernel((0.0, 0.0), step, "up double, down double, alarm int")


def predictive_gate(alpha: float, limit: float) -> Kernel:
    """Pass a value only where it is off its exponential mean by more than the limit."""

    def step(s: State, v: tuple, t: float):
        if s[0] is None:
            return (v[0],), (v[0],)
        return (s[0] * (1 - alpha) + v[0] * alpha,), ((v[0],) if abs(v[0] - s[0]) > limit else None)

    return Kernel((None,), step, "passed double")


def rate_limit(seconds: float) -> Kernel:
    """Pass a row only if so long ago another one passed."""

    def step(s: State, v: tuple, t: float):
        if s[0] is not None and t - s[0] < seconds:
            return s, None
        return (t,), (t,)

    return Kernel((None,), step, "passed_at double")


def smoothed_motion(frames: int = 4, alpha: float = 0.15, slow: float = 0.003, warm_up: int = 50) -> Kernel:
    """Motion above 0.7 of a baseline, smoothed; a new class counts once it was seen in so many further frames.

    The baseline follows quickly before frame ``warm_up`` and then slowly, while motion is near the smoothed one.
    """

    def step(s: State, v: tuple, t: float):
        n, base, smooth, level, wanted, held = s
        n += 1
        if n < warm_up:
            base = base * 0.9 + v[0] * 0.1
        elif v[0] < smooth + 0.05:
            base = base * (1 - slow) + v[0] * slow
        smooth = smooth * (1 - alpha) + max(v[0] - base * 0.7, 0.0) * alpha
        now = sum(smooth > x for x in MOTION_STEPS)
        if now == level:
            wanted, held = now, 0
        elif now == wanted:
            held += 1
            if held >= frames:
                level, held = now, 0
        else:
            wanted, held = now, 1
        return (n, base, smooth, level, wanted, held), (smooth, MOTION_CLASSES[level], smooth > 0.03)

    return Kernel((0, 0.0, 0.0, 0, 0, 0), step, "smooth double, level string, presence boolean")


def action_gate(margin: float = 0.05, debounce: float = 5.0) -> Kernel:
    """A ladder of actions by risk score: an edge must be passed by a margin, and a new action wanted for so many seconds.

    Edges and margins are decimals, so 0.9 and 0.05 make 0.95 and not the sum of their nearest doubles.
    """
    above, below = (tuple(float(Decimal(str(e)) + way * Decimal(str(margin))) for e in ACTION_EDGES) for way in (1, -1))

    def step(s: State, v: tuple, t: float):
        now, wanted, since = s
        raw = sum(v[0] >= e for e in ACTION_EDGES)
        if raw > now:
            target = raw if v[0] >= above[now] else now
        elif raw < now:
            target = raw if v[0] < below[now - 1] else now
        else:
            target = now
        if target == now:
            wanted, since = -1, 0.0
        elif wanted != target:
            wanted, since = target, t
        elif t - since >= debounce:
            now, wanted, since = target, -1, 0.0
        return (now, wanted, since), (ACTIONS[now],)

    return Kernel((0, -1, 0.0), step, "action string")


def sleeping(dwell: float = 300.0, leave: float = 30.0, warm_up: float = 60.0) -> Kernel:
    """Values presence, motion, breathing rate, confidence.  Rows where someone falls asleep or wakes.

    Asleep after ``dwell`` seconds of presence, little motion and calm breathing;
    awake at once without presence, or after ``leave`` seconds of motion.  A row
    may lack the rate or its confidence: nobody falls asleep then, but sleepers still wake.
    """

    def step(s: State, v: tuple, t: float):
        asleep, since = s
        presence, motion, rate, confidence = v
        if t < warm_up:
            return s, None
        if not asleep:
            if not (presence and motion < 0.05 and not _missing(rate) and not _missing(confidence) and 8 <= rate <= 20 and confidence >= 0.5):
                return (False, None), None
            since = t if since is None else since
            return ((True, None), (True,)) if t - since >= dwell else ((False, since), None)
        if presence and motion <= 0.15:
            return (True, None), None
        since = t if since is None else since
        return ((False, None), (False,)) if not presence or t - since >= leave else ((True, since), None)

    return Kernel((False, None), step, "asleep boolean", (2, 3))


def distress(multiple: float = 1.5, dwell: float = 60.0, pause: float = 300.0, warm_up: float = 60.0, alpha: float = 0.01) -> Kernel:
    """Values heart rate, confidence, motion, fallen.  Rows where distress begins or ends.

    Begins after ``dwell`` seconds of a heart rate of ``multiple`` times its calm
    mean with motion and no fall, ``pause`` seconds after the last end at the
    earliest; ends when motion and heart rate are low again.
    """

    def step(s: State, v: tuple, t: float):
        active, base, since, left = s
        rate, confidence, motion, fallen = v
        if confidence < 0.5:
            return s, None
        followed = rate if base is None else alpha * rate + (1 - alpha) * base
        if t < warm_up or base is None or base <= 0:
            return (active, followed, since, left), None
        high, agitated = rate / base >= multiple, motion > 0.20
        if active:
            if motion < 0.10 and rate / base < 1.2:
                return (False, base, None, t), (False,)
            return s, None
        if not agitated and not high:
            base = followed
        if left is not None and t - left < pause:
            return (False, base, since, left), None
        if not (high and agitated and not fallen):
            return (False, base, None, left), None
        since = t if since is None else since
        return ((True, base, since, left), (True,)) if t - since >= dwell else ((False, base, since, left), None)

    return Kernel((False, None, None, None), step, "distress boolean")


def room_active(threshold: float = 0.10, window: float = 30.0, idle: float = 600.0, warm_up: float = 60.0) -> Kernel:
    """Values presence, motion.  Active from motion with presence until nobody is there or ``idle`` seconds pass."""

    def step(s: State, v: tuple, t: float):
        active, last = s
        presence, motion = v
        if t < warm_up:
            return s, None
        last = t if presence and motion >= threshold else last
        if not active and presence and last is not None and t - last < window:
            return (True, last), (True,)
        if active and (not presence or last is None or t - last >= idle):
            return (False, last), (False,)
        return (active, last), None

    return Kernel((False, None), step, "active boolean")


def meeting(persons: int = 2, dwell: float = 600.0, leave: float = 120.0, warm_up: float = 60.0) -> Kernel:
    """Values persons, motion.  A meeting after ``dwell`` seconds of enough persons with little motion."""

    def step(s: State, v: tuple, t: float):
        active, since = s
        if t < warm_up:
            return s, None
        if (v[0] >= persons) if active else not (v[0] >= persons and 0.01 <= v[1] < 0.20):
            return (active, None), None
        since = t if since is None else since
        if t - since >= (leave if active else dwell):
            return (not active, None), (not active,)
        return (active, since), None

    return Kernel((False, None), step, "meeting boolean")


def inactivity(multiple: float = 2.0, floor: float = 1800.0, pause: float = 86_400.0, warm_up: float = 60.0) -> Kernel:
    """Values presence, motion.  Stillness of ``multiple`` times the longest one before, at most once in ``pause`` seconds."""

    def step(s: State, v: tuple, t: float):
        active, longest, since, fired = s
        if t < warm_up:
            return s, None
        if not (v[0] and v[1] < 0.02):
            longest = longest if since is None else max(longest, t - since)
            return (False, longest, None, fired), ((False,) if active else None)
        since = t if since is None else since
        if not active and t - since >= longest * multiple and (fired is None or t - fired >= pause):
            return (True, longest, since, t), (True,)
        return (active, longest, since, fired), None

    return Kernel((False, floor, None, None), step, "anomaly boolean")


def spaced() -> Kernel:
    """Values pause and any other: rows at least their pause after the last row that passed, with the other value."""

    def step(s: State, v: tuple, t: float):
        return (s, None) if s[0] is not None and t - s[0] < v[0] else ((t,), (float(v[1]),))

    return Kernel((None,), step, "value double")


def beside_mean(alpha: float) -> Kernel:
    """Values rate and frame: both again, beside the exponential mean started at the first rate."""

    def step(s: State, v: tuple, t: float):
        mean = v[0] if s[0] is None else s[0] + alpha * (v[0] - s[0])
        return (mean,), (v[0], v[1], mean)

    return Kernel((None,), step, "rate double, frame long, mean double")


def occupied_zone(arrive: int = 200, leave: int = 6000, every: int = 20, alpha: float = 0.1) -> Kernel:
    """Values presence score, motion.  Every so many rows: occupied, activity, and what is left of the time to leave.

    The state turns after so many rows on end that speak against it.
    """

    def step(s: State, v: tuple, t: float):
        n, on, against, mean = s
        n, mean = n + 1, mean * (1 - alpha) + v[1] * alpha
        against = against + 1 if (v[0] > 0.5) != on else 0
        if against >= (leave if on else arrive):
            on, against = not on, 0
        shown = (on, 1.0 if mean > 0.3 else mean, 1 - against / leave if on and against else None)
        return (n, on, against, mean), (shown if n % every == 0 else None)

    return Kernel((0, False, 0, 0.0), step, "occupied boolean, activity double, countdown double")


def loitering(confirm: int = 60, dwell: int = 6000, leave: int = 600, report: int = 600, pause: int = 200, rate: float = 20.0) -> Kernel:
    """Values presence, motion.  ``start``, ``ongoing`` and ``end`` of loitering with the seconds stayed.

    Starts after ``dwell`` still rows of a confirmed stay (absences below half of ``leave`` rows do not end it),
    ends after ``leave`` rows of absence; the next stay can begin ``pause`` rows later.
    """
    away, entering, staying = range(3)  # and loitering beyond

    def step(s: State, v: tuple, t: float):
        phase, count, stayed, told, rest = s  # count: rows of presence on entering, of absence later
        rest = max(rest - 1, 0)
        there, still = v[0], v[1] < 0.5
        if phase == away:
            return ((entering, 1, 0, 0, rest) if there and not rest else (away, 0, 0, 0, rest)), None
        if phase == entering:
            if not there:
                return (away, 0, 0, 0, rest), None
            return ((staying, 0, 0, 0, rest) if count + 1 >= confirm else (entering, count + 1, 0, 0, rest)), None
        if there:
            stayed += 1 if phase > staying or still else 0
            if phase == staying:
                begun = stayed >= dwell
                return (phase + begun, 0, stayed, 0, rest), (("start", stayed / rate) if begun else None)
            told = (told + 1) % report
            return (phase, 0, stayed, told, rest), (None if told else ("ongoing", stayed / rate))
        if count + 1 < (leave // 2 if phase == staying else leave):
            return (phase, count + 1, stayed, told, rest), None
        return ((away, 0, 0, 0, rest), None) if phase == staying else ((away, 0, 0, 0, pause), ("end", stayed / rate))

    return Kernel((away, 0, 0, 0, 0), step, "alert string, seconds double")


def hash_links(genesis: str = "0" * 64) -> Kernel:
    """Value: a record's canonical text.  Each link is the hash of the link before, the number and the text."""

    def step(s: State, v: tuple, t: float):
        seq, before = s
        link = hashlib.sha256(f"{before}|{seq}|{v[0]}".encode()).hexdigest()
        return (seq + 1, link), (seq, before, link)

    return Kernel((0, genesis), step, "seq long, prev string, link string")


def resonator(low: float, high: float, rate: float) -> Kernel:
    """A second-order band pass from ``low`` to ``high`` hertz at ``rate`` samples a second."""
    a, b = (2 * math.pi * f / rate for f in (low, high))
    r, turn = min(max(1 - (b - a) / 2, 0.0), 0.9999), math.cos((a + b) / 2)

    def step(s: State, v: tuple, t: float):
        x1, x2, y1, y2 = s
        y = (1 - r) * (v[0] - x2) + 2 * r * turn * y1 - r * r * y2
        return ((v[0], x1, y, y1), (y,)) if math.isfinite(y) else ((0.0,) * 4, (0.0,))

    return Kernel((0.0,) * 4, step, "filtered double")


def carrying(kernel: Kernel, rest: str) -> Kernel:
    """The kernel on the first value; the other ones (``rest`` names their types) go out with its outputs."""

    def step(s: State, v: tuple, t: float):
        state, got = kernel.step(s, v[:1], t)
        return state, None if got is None else (*got, *v[1:])

    return Kernel(kernel.start, step, f"{kernel.output}, {rest}")


def _missing(v: object) -> bool:
    return v is None or (isinstance(v, float) and math.isnan(v))


def fold(df: DataFrame, key: str, order: Sequence[str], x: str | Sequence[str], t: str, row_id: str, kernel: Kernel) -> DataFrame:
    """Rows (key, row_id, outputs) that the kernel gives, key by key in order; ``x`` names one value or several."""
    kinds = dict(df.dtypes)
    columns = [x] if isinstance(x, str) else list(x)
    schema = StructType.fromDDL(f"`{key}` {kinds[key]}, `{row_id}` {kinds[row_id]}, {kernel.output}")
    arrow = to_arrow_schema(schema)
    cast = lambda c: F.col(c).cast("double") if isinstance(x, str) and kinds[c] not in ("string", "boolean") else F.col(c)
    values = [cast(c).alias(f"__el_x{k}") for k, c in enumerate(columns)]
    rows = df.select(F.col(key).alias("__el_key"), F.col(row_id).alias("__el_id"), F.col(t).cast("double").alias("__el_t"), *values, *[F.col(c).alias(f"__el_o{k}") for k, c in enumerate(order)])
    rows = rows.repartition("__el_key").sortWithinPartitions("__el_key", *[f"__el_o{k}" for k in range(len(order))])
    rows = rows.select("__el_key", "__el_id", "__el_t", *[f"__el_x{k}" for k in range(len(columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), kernel.start
        for batch in batches:
            out = []
            for k, i, s, *v in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != last:
                    last, state = k, kernel.start
                if s is None or any(_missing(x) for n, x in enumerate(v) if n not in kernel.optional):
                    continue
                state, got = kernel.step(state, tuple(v), s)
                if got is not None:
                    out.append((k, i, *got))
            held = list(zip(*out, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def fold_stream(df: DataFrame, key: str, order: Sequence[str], x: str, t: str, row_id: str, kernel: Kernel) -> DataFrame:
    """The same over a stream whose batches bring each key's rows in order, for kernels with numeric states."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kinds = dict(df.dtypes)
    names = [key, row_id, *[c.split()[0] for c in kernel.output.split(", ")]]
    held = ", ".join(f"s{k} double" for k in range(len(kernel.start)))

    def run(own, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else kernel.start
        rows = pd.concat(list(frames)).sort_values(list(order))  # one key's rows of one batch
        out = []
        for i, v, s in zip(rows[row_id].tolist(), rows[x].tolist(), rows[t].tolist(), strict=True):
            if _missing(s) or _missing(v):
                continue
            now, got = kernel.step(now, (float(v),), float(s))
            if got is not None:
                out.append((own[0], i, *got))
        state.update(tuple(None if v is None else float(v) for v in now))
        yield pd.DataFrame(out, columns=names)

    return df.groupBy(key).applyInPandasWithState(run, f"`{key}` {kinds[key]}, `{row_id}` {kinds[row_id]}, {kernel.output}", held, "append", GroupStateTimeout.NoTimeout)
