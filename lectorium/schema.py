"""Schemas of what a library keeps."""

from __future__ import annotations

BOOK = (
    "title string, author string, chapters array<struct<id: string, title: string, level: int, first_block: int>>, "
    "blocks array<struct<id: string, kind: string, chapter: int, stanza: int, text: string, em: array<array<int>>, strong: array<array<int>>, sup: array<array<int>>, sub: array<array<int>>, "
    "notes: array<struct<pos: int, id: string, m: string>>, sentences: array<array<int>>, audio: boolean>>"
)
CAPTIONS = "events array<struct<tStartMs: bigint, segs: array<struct<utf8: string, tOffsetMs: bigint>>>>"
TIMING_HEADER = "source string, duration double"
HIT = (
    "source string, title string, author string, translator string, year string, size_kb int, lang string, url string, kind string, audio_url string, narrator string, readable boolean"
)
RECORDING = "source string, ref string, title string, author string, narrator string, duration_s int, parts int, size_bytes bigint, bitrate_kbps int, captions boolean, page_url string, licensed_trial boolean"

#: Keys of a device's state that the last writer decides.
STATE_KEYS = ("pos", "sent", "mode", "opened", "shelf", "finished")
