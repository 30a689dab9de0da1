"""Which track plays as a session's recognitions come in, event by event.

``switch`` takes the state and one event and says what happens: a concert that
is new plays; one of the same band moves on in that band's playlist to a track
that sounds different, with at most four tries; one of another band starts a
playlist of its own. Batches and streams both call it, so they decide alike.

Playlists are shuffled by a rule instead of by chance, so that an event that is
handled again after a restart gives the same playlist: songs go by
``(id * SPREAD + turn * STEP) % MODULUS``, then id, and the turn counts the
session's shuffles.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .walk import walk

#: Parameters of the shuffle.
SPREAD, STEP, MODULUS = 7919, 104729, 10007
MOST_TRIES = 4
#: Lists of songs that a task keeps at most.
LISTS_KEPT = 10_000
SONGS = "songs array<struct<id:int,audio:string>>"
EVENT_COLUMNS = ["session_id", "seq", "is_active", "concert_id", "band", "audio", "songs"]
SWITCH = "session_id string, seq bigint, action string, playing int, place int, tries int"
COLUMNS = [c.split()[0] for c in SWITCH.split(", ")]
STATE = "previous int, playing int, playing_audio string, band string, playlist array<int>, place int, turns int"


@dataclass
class Playback:
    previous: int | None = None
    playing: int | None = None
    playing_audio: str | None = None
    band: str | None = None
    playlist: list[int] = field(default_factory=list)
    place: int = 0
    turns: int = 0

    def shuffled(self, ids: list[int]) -> list[int]:
        self.turns += 1
        return sorted(ids, key=lambda i: ((i * SPREAD + self.turns * STEP) % MODULUS, i))

    def advance(self, songs: dict[int, str | None]) -> int | None:
        """The next track of the playlist, which is shuffled anew after its last."""
        if self.playing is None:
            return None
        if self.playing not in self.playlist:
            self.playlist = self.shuffled(list(songs) or [self.playing])
            self.place = self.playlist.index(self.playing) if self.playing in self.playlist else 0
        if len(self.playlist) < 2:
            return None
        self.place += 1
        if self.place >= len(self.playlist):
            self.playlist, self.place = self.shuffled(self.playlist), 0
        return self.playlist[self.place]


def switch(state: Playback, event: dict) -> dict:
    """Advance the state by an event and say what is done: its action, the track that plays, its place and the tries that took."""
    tries = 0

    def done(action: str) -> dict:
        return {"session_id": event["session_id"], "seq": int(event["seq"]), "action": action, "playing": state.playing, "place": state.place, "tries": tries}

    concert = event["concert_id"]
    if concert is None:
        state.previous = None
        return done("cleared")
    if not event["is_active"]:
        return done("inactive")
    seen, state.previous = state.previous == concert, concert
    if seen:
        return done("same")
    if not event["audio"]:
        return done("silent")
    if concert == state.playing:
        return done("already_playing")
    songs = {s["id"]: s["audio"] for s in event["songs"]}
    if state.band is not None and event["band"] == state.band:
        while tries < MOST_TRIES:
            tries += 1
            track = state.advance(songs)
            if track is None:
                break
            if songs.get(track) and track != state.playing and songs[track] != state.playing_audio:
                state.playing, state.playing_audio = track, songs[track]
                return done("advanced")
        return done("kept")
    state.band, state.place = event["band"], 0
    state.playlist = [concert, *state.shuffled([i for i in songs if i != concert])]
    state.playing, state.playing_audio = concert, event["audio"]
    return done("started")


def with_songs(events: DataFrame, concerts: DataFrame) -> DataFrame:
    """events (session_id, seq, is_active, concert_id) with band, audio and the band's songs; an unknown concert counts as none.

    concerts: id, band, audio. A band's songs are one list, as its playlist is.
    """
    own = concerts.select(F.col("id").cast("int").alias("concert_id"), "band", "audio")
    songs = concerts.groupBy("band").agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("int").alias("id"), "audio"))).alias("songs"))
    known = own.join(songs, "band", "left")
    rows = events.select("session_id", F.col("seq").cast("bigint").alias("seq"), "is_active", F.col("concert_id").cast("int").alias("wanted"))
    return rows.join(known, rows["wanted"] == known["concert_id"], "left").select(*EVENT_COLUMNS)


def _decided(rows: pd.DataFrame, state: Playback) -> pd.DataFrame:
    out = []
    for r in rows.sort_values("seq", kind="stable").to_dict("records"):
        r["concert_id"] = None if pd.isna(r["concert_id"]) else int(r["concert_id"])
        out.append(switch(state, r))
    table = pd.DataFrame(out, columns=COLUMNS)
    return table.astype({"playing": "Int32", "place": "int32", "tries": "int32"})


def play(events: DataFrame) -> DataFrame:
    """What is done at each event of finished sessions; a session is in one task, as its events build on each other.

    Lists of songs travel as texts, so that each list is read once a task and not once an event.
    """
    lists: dict[str | None, list[dict] | None] = {None: None}

    def told(state: Playback, event: dict) -> dict:
        text = event["songs"]
        if text not in lists:
            if len(lists) >= LISTS_KEPT:
                lists.clear()
            lists[text] = None if text is None else json.loads(text)
        return switch(state, event | {"songs": lists[text]})

    songs = F.to_json("songs", {"ignoreNullFields": "false"}).alias("songs")
    return walk(events.select(*EVENT_COLUMNS[:-1], songs), "session_id", "seq", Playback, told, SWITCH)


def play_stream(events: DataFrame, forget_after_ms: int | None = None) -> DataFrame:
    """What is done at each event of a stream, the state kept per session in typed columns.

    With ``forget_after_ms`` a session that nothing was written to for so long is
    forgotten. The session needs the RocksDB state store.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Switching(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("playback", STATE, forget_after_ms) if forget_after_ms else handle.getValueState("playback", STATE)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            held = self.state.get() if self.state.exists() else None
            state = Playback(*held[:4], list(held[4]), *held[5:]) if held else Playback()
            yield _decided(pd.concat(list(rows)), state)
            self.state.update((state.previous, state.playing, state.playing_audio, state.band, state.playlist, state.place, state.turns))

        def close(self) -> None:
            pass

    return events.select(*EVENT_COLUMNS).groupBy("session_id").transformWithStateInPandas(
        Switching(), SWITCH, "Append", "ProcessingTime" if forget_after_ms else "None"
    )
