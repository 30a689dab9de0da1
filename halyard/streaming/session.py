"""The recognition state machine of a session, frame by frame, in batches and in streams.

``step`` takes the state and one frame and gives the new state and a decision
row. Frames are ordered by frame_id; a frame that is not after the last one seen
is dropped, as is one that arrives when its session is done. Under a throttle
every second frame is skipped as long as no candidate is tracked, so the state
decides which frames it will see. Both the batch and the streaming form call
it, so they decide alike.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.asof import as_of
from ..presets import (
    AMBIENT_WEIGHT, BLUR_CLEARING_RUN, BLUR_COUNTED_RUN, BLUR_GATE_FRACTION, BLUR_IMPROVEMENT, CONFIRM_RUN, INSTANT_DISTANCE,
    NEAR_MISS_SPAN, QUALITY_GATE_DISTANCE, Preset,
)
from .walk import walk

DECISION = (
    "session_id string, frame_id bigint, event string, category string, best_id int, best_distance int, margin int, ambiguous boolean, "
    "near_miss boolean, passed boolean, quality_checked boolean, quality_bypassed boolean, failed_attempt boolean, recognized int, "
    "sharpness double, glare_percent double, brightness double, ambient_brightness double, ambient_glare double"
)
COLUMNS = [c.split()[0] for c in DECISION.split(", ")]
FLAGS = ("ambiguous", "near_miss", "passed", "quality_checked", "quality_bypassed", "failed_attempt")
#: A decision row before anything is decided.
UNDECIDED = dict.fromkeys(COLUMNS) | dict.fromkeys(FLAGS, False)
FRAME_COLUMNS = [
    "session_id", "frame_id", "best_id", "best_distance", "second_id", "second_distance", "sharpness", "glare_percent", "brightness", "pre_hash_sharpness",
]


@dataclass
class State:
    last_frame: int = -1
    recognized: int | None = None
    candidate: int | None = None
    run: int = 0
    ambient: float | None = None
    ambient_glare: float | None = None
    blur_run: int = 0
    last_distance: int | None = None
    #: Frames presented, skipped ones among them.
    presented: int = 0

    def clear(self) -> None:
        self.candidate, self.run = None, 0


def thresholds(preset: Preset, ambient: float | None, glare: float | None) -> tuple[float, float, float]:
    """Lowest and highest brightness and largest glare that pass in the ambient light."""
    low, high, most = preset.min_brightness, preset.max_brightness, preset.glare_percent
    if ambient is None:
        return low, high, most
    shift = (ambient - (low + high) / 2) * 0.35
    moved = most + max(0.0, (160 - ambient) / 8) + (glare * 0.2 if glare is not None else 0.0)
    return min(max(low + shift, 20.0), low + 30), min(max(high + shift, high - 30), 245.0), min(max(moved, most), 40.0)


def _smooth(old: float | None, new: float) -> float:
    return new if old is None else old * (1 - AMBIENT_WEIGHT) + new * AMBIENT_WEIGHT


def _missing(x) -> bool:
    return x is None or x != x


def step(state: State, frame: dict, preset: Preset) -> dict:
    """Advance the state by a frame and say what was decided."""
    out, number = UNDECIDED.copy(), int(frame["frame_id"])
    out["session_id"], out["frame_id"] = frame["session_id"], number

    def value(k: str):
        x = frame.get(k)
        return None if x is None or x != x else x

    def whole(k: str) -> int | None:
        x = frame.get(k)
        return None if x is None or x != x else int(x)

    def done(event: str, **more) -> dict:
        out["event"], out["recognized"], out["ambient_brightness"], out["ambient_glare"] = event, state.recognized, state.ambient, state.ambient_glare
        if more:
            out.update(more)
        return out

    if frame["frame_id"] <= state.last_frame:
        return done("dropped")
    state.presented += 1
    if preset.throttle and state.candidate is None and state.presented % 2:
        state.last_frame = number
        return done("skipped")
    if state.recognized is not None and not preset.continuous:
        return done("dropped")
    state.last_frame = number

    if preset.path == "inline" and (pre := value("pre_hash_sharpness")) is not None and pre < preset.sharpness * BLUR_GATE_FRACTION:
        return done(**_blurred(state, pre))

    best, distance, second = whole("best_id"), whole("best_distance"), whole("second_distance")
    margin = second - distance if second is not None and distance is not None else None
    within = distance is not None and distance <= preset.threshold
    boost = int(preset.boost_near_threshold and distance is not None and distance >= max(preset.threshold - 1, 0))
    enough = margin is None or margin >= preset.margin + boost
    active = within and enough and margin != 0
    out["best_id"], out["best_distance"], out["margin"], out["ambiguous"] = best, distance, margin, within and not active

    if distance is None or not active or distance > QUALITY_GATE_DISTANCE:
        sharpness, glare, light = value("sharpness"), value("glare_percent"), value("brightness")
        if sharpness is not None and glare is not None and light is not None:
            out["quality_checked"], out["sharpness"], out["glare_percent"], out["brightness"] = True, sharpness, glare, light
            state.ambient, state.ambient_glare = _smooth(state.ambient, light), _smooth(state.ambient_glare, glare)
            low, high, most = thresholds(preset, state.ambient, state.ambient_glare)
            if sharpness < preset.sharpness:
                if preset.path == "worker":
                    before, state.last_distance = state.last_distance, distance
                    if before is not None and distance is not None and before - distance >= BLUR_IMPROVEMENT:
                        state.blur_run = 0
                        return done("improving")
                return done(**_blurred(state, sharpness))
            if glare > most or not low <= light <= high:
                state.blur_run = 0
                state.clear()
                glaring = glare > most
                return done("glare_rejected" if glaring else "lighting_rejected", category="glare" if glaring else "poor-quality")
            state.last_distance = distance
        else:
            state.last_distance = None
        state.blur_run = 0
    else:
        out["quality_bypassed"] = True
        state.blur_run, state.last_distance = 0, None

    out["passed"] = True
    out["near_miss"] = distance is not None and preset.threshold < distance <= preset.threshold + NEAR_MISS_SPAN
    if active:
        if best == state.recognized:
            state.clear()
            return done("already_recognized")
        state.run = state.run + 1 if best == state.candidate else 1
        if distance <= INSTANT_DISTANCE or state.run >= CONFIRM_RUN:
            state.recognized = best
            state.clear()
            return done("confirmed_instant" if distance <= INSTANT_DISTANCE else "confirmed")
        state.candidate = best
        return done("candidate")
    near = out["ambiguous"] or distance is not None and distance <= preset.threshold + 2
    lost = state.candidate is not None
    state.clear()
    return done("no_match", category="collision" if near else "no-match", failed_attempt=lost)


def _blurred(state: State, sharpness: float) -> dict:
    """The first blurred frame passes silently, the second counts, the third clears the candidate."""
    state.blur_run += 1
    if state.blur_run < BLUR_COUNTED_RUN:
        return {"event": "blur_ignored", "sharpness": sharpness}
    if state.blur_run >= BLUR_CLEARING_RUN:
        state.clear()
    return {"event": "blur_rejected", "category": "motion-blur", "sharpness": sharpness}


def _table(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS).astype(object).where(lambda x: x.notna(), None)


def _rows(frames: pd.DataFrame, state: State, preset: Preset) -> pd.DataFrame:
    ordered = frames.sort_values("frame_id", kind="stable")
    return _table([step(state, f, preset) for f in ordered.to_dict("records")])


def recognize(frames: DataFrame, preset: Preset) -> DataFrame:
    """Decision rows of finished sessions; a session is in one task, as its frames build on each other."""
    return walk(frames.select(*FRAME_COLUMNS), "session_id", "frame_id", State, lambda state, f: step(state, f, preset), DECISION)


def recognize_stream(frames: DataFrame, preset: Preset) -> DataFrame:
    """Decision rows of a stream of frames, the state kept per session.

    Late frames, those not after the last one decided, are dropped: a policy of
    this engine, as there is none for a single in-order session.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = State(**json.loads(group.get[0])) if group.exists else State()
        for rows in (_rows(pd.concat(list(batches)), state, preset),):
            yield rows
        group.update((json.dumps(asdict(state)),))

    return frames.select(*FRAME_COLUMNS).groupBy("session_id").applyInPandasWithState(
        run, DECISION, "state string", "append", GroupStateTimeout.NoTimeout
    )


#: What a settings message changes; what it leaves null stays the preset's.
SETTINGS = "threshold int, margin int, sharpness double, glare_percent double, min_brightness double, max_brightness double"
SETTING_NAMES = [c.split()[0] for c in SETTINGS.split(", ")]
#: Settings whose presets a task keeps at most.
PRESETS_KEPT = 10_000
#: A message of a session: init and config-update carry settings, frame a frame; frame_id numbers a session's messages.
MESSAGE = (
    "session_id string, frame_id bigint, ts timestamp, kind string, settings struct<" + ",".join(c.replace(" ", ":") for c in SETTINGS.split(", ")) + ">, "
    "best_id int, best_distance int, second_id int, second_distance int, sharpness double, glare_percent double, brightness double, pre_hash_sharpness double"
)


def changed(preset: Preset, settings) -> Preset | None:
    """The preset with a message's settings; none if they are not valid together."""
    if settings is None:
        return None
    try:
        return preset.with_(**{k: v for k, v in plain_settings(settings).items() if v is not None})
    except ValueError:
        return None


def plain_settings(settings) -> dict:
    """A message's settings as Python numbers, which is what typed state keeps."""
    kinds = {"threshold": int, "margin": int}
    return {k: None if _missing(v := settings[k]) else kinds.get(k, float)(v) for k in SETTING_NAMES}


def _uninitialized(frame: dict) -> dict:
    """A frame before any valid settings: it is told and changes nothing."""
    return UNDECIDED | {"session_id": frame["session_id"], "frame_id": int(frame["frame_id"]), "event": "not_initialized"}


def recognize_messages(messages: DataFrame, preset: Preset) -> DataFrame:
    """Decision rows of the frames of finished sessions, each under the settings in force when it came.

    Settings meet frames by an as-of join on the message number; of the messages
    with one number settings count first. Settings that aren't valid are passed
    over, and frames before the first valid ones are told as not_initialized.
    """
    valid = F.coalesce(F.col("settings.threshold") >= QUALITY_GATE_DISTANCE, F.col("settings").isNotNull())
    versions = messages.filter(F.col("kind").isin("init", "config-update") & valid)
    frames = messages.filter("kind = 'frame'").select(*FRAME_COLUMNS)
    configured = as_of(frames, versions, ["session_id"], "frame_id", F.col("settings"), "settings")

    presets: dict[tuple, Preset | None] = {}  # of settings seen lately

    def told(state: State, f: dict) -> dict:
        settings = f["settings"]
        if settings is None:
            return _uninitialized(f)
        values = tuple(None if _missing(settings[k]) else settings[k] for k in SETTING_NAMES)
        if values not in presets:
            if len(presets) >= PRESETS_KEPT:
                presets.clear()
            presets[values] = changed(preset, settings)
        return step(state, f, presets[values])

    return walk(configured, "session_id", "frame_id", State, told, DECISION)


def recognize_messages_stream(messages: DataFrame, preset: Preset, late: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """Decision rows of a stream of messages; a session that sends nothing for ``idle_ms`` is closed and its state dropped.

    State and settings are kept in typed columns, written once a batch. Each
    message moves the session's timer; when the watermark passes it a row
    session_closed is given, numbered as the last frame, and a later message
    begins a new session. Messages later than the watermark are dropped. The
    session needs the RocksDB state store.
    """
    from pyspark.sql.streaming import StatefulProcessor

    kept = (
        "last_frame bigint, recognized int, candidate int, run int, ambient double, ambient_glare double, blur_run int, last_distance int, presented int"
    )
    names = [c.split()[0] for c in kept.split(", ")]

    class Sessions(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("session", kept)
            self.settings = handle.getValueState("settings", SETTINGS)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            state = State(**dict(zip(names, self.state.get(), strict=True))) if self.state.exists() else State()
            held = dict(zip(SETTING_NAMES, self.settings.get(), strict=True)) if self.settings.exists() else None
            current, out = changed(preset, held), []
            table = pd.concat(list(rows))
            table["_frame"] = table["kind"] == "frame"
            for m in table.sort_values(["frame_id", "_frame"], kind="stable").to_dict("records"):
                if m["kind"] == "frame":
                    out.append(step(state, m, current) if current else _uninitialized(m))
                elif m["kind"] in ("init", "config-update") and (new := changed(preset, m["settings"])):
                    held, current = plain_settings(m["settings"]), new
            if held is not None:
                self.settings.update(tuple(held.values()))
            self.state.update(tuple(getattr(state, k) for k in names))
            at = int(table["ts"].max().timestamp() * 1000) + idle_ms
            for old in list(self.handle.listTimers()):
                at = max(at, old)
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
            yield _table(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            last = dict(zip(names, self.state.get(), strict=True)) if self.state.exists() else {"last_frame": -1, "recognized": None}
            self.state.clear()
            self.settings.clear()
            yield _table([_uninitialized({"session_id": key[0], "frame_id": last["last_frame"]}) | {"event": "session_closed", "recognized": last["recognized"]}])

        def close(self) -> None:
            pass

    wanted = ["ts", "kind", "settings", *(c for c in FRAME_COLUMNS if c != "session_id")]
    return messages.withWatermark("ts", late).select("session_id", *wanted).groupBy("session_id").transformWithStateInPandas(Sessions(), DECISION, "Append", "EventTime")


def hold_rectangles(detections: list[tuple[bool, float, object]], least: float = 0.6, most: int = 2) -> list[object | None]:
    """The rectangle in use at each frame: a confident one, else the last confident one for up to ``most`` frames."""
    held, used, out = None, 0, []
    for detected, confidence, rectangle in detections:
        if detected and confidence >= least:
            held, used = rectangle, 0
            out.append(rectangle)
        elif held is not None and used < most:
            used += 1
            out.append(held)
        else:
            if not detected:
                held, used = None, 0
            out.append(None)
    return out
