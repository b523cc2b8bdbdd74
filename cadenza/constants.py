"""Values of the catalogue domain that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

# Key names, their spellings, the Camelot wheel, key profiles, statuses.
KEY_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
SEMITONES = {
    "C": 0, "C#": 1, "Db": 1, "D": 2, "D#": 3, "Eb": 3, "E": 4, "F": 5, "F#": 6, "Gb": 6,
    "G": 7, "G#": 8, "Ab": 8, "A": 9, "A#": 10, "Bb": 10, "B": 11,
}
CAMELOT_MAJOR = ["8B", "3B", "10B", "5B", "12B", "7B", "2B", "9B", "4B", "11B", "6B", "1B"]
CAMELOT_MINOR = ["5A", "12A", "7A", "2A", "9A", "4A", "11A", "6A", "1A", "8A", "3A", "10A"]
MAJOR_PROFILE = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR_PROFILE = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
STATUSES = ["queued", "downloaded", "stemmed", "analysed", "error"]
STEM_TYPES = ["full", "vocals", "instrumental"]
VOCAL_OVER_INSTRUMENTAL = "vocal_over_instrumental"
INSTRUMENTAL_OVER_INSTRUMENTAL = "instrumental_over_instrumental"
# Download attempts, searches, preview bounds, defaults of matching.
#: Download attempts in order: label, format, player clients, with cookies.
ATTEMPTS = [
    ("ios+bestaudio", "bestaudio/best", "youtube:player_client=ios", False),
    ("android_web+bestaudio", "bestaudio/best", "youtube:player_client=android,web", False),
    ("android_web+ba/b", "ba/b", "youtube:player_client=android,web", False),
    ("cookies+android_web+ba/b", "ba/b", "youtube:player_client=android,web", True),
]
SEARCH_SUFFIXES = [" official audio", " lyrics", ""]
SEARCH_RESULTS = 5
#: Seconds up to which audio is a preview; KB under which a file of unknown length is one, taken for 30 s.
PREVIEW_SECS, PREVIEW_KB = 35.0, 560.0


@dataclass(frozen=True)
class MatchConfig:
    """Thresholds (both inclusive) and weights of pair matching."""

    bpm_max: float = 10.0
    key_min: float = 0.55
    weights: dict[str, float] = field(default_factory=lambda: {"bpm": 0.25, "key": 0.30, "energy": 0.20, "timbre": 0.25})
