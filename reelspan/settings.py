"""Detection settings with their defaults, and the word lists of the text signals."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any

# Word lists, constants and patterns that results depend on. Where order has no meaning, words are sorted.
EMOTION_WORDS = (
    "amazing", "betrayed", "brutal", "crazy", "devastated", "disaster", "disgusting", "ecstatic", "explosive", "exposed", "fantastic",
    "furious", "hate", "heartbroken", "horrible", "humiliated", "incredible", "insane", "love", "miracle", "nightmare", "outraged",
    "ridiculous", "savage", "scandal", "shocking", "stunning", "terrifying", "thrilled", "unbelievable", "wild",
)
QUESTION_OPENERS = ("who", "what", "why", "how", "when", "where", "which", "is it", "are you", "do you", "can you", "should")
HOOK_PHRASES = (
    "the truth is", "nobody talks about", "here's why", "what nobody tells you", "the real reason", "this changes everything",
    "you won't believe", "i can't believe", "the secret to", "nobody tells you", "the biggest mistake", "here's the thing",
    "what they don't want you to know", "the hard truth", "let me explain",
)
BAD_STARTERS = ("and", "because", "but", "it", "so", "that", "they", "this", "those", "which")
NEEDS_CONTEXT = ("because", "he", "it", "she", "so", "that", "them", "therefore", "they", "this", "those", "thus", "which")
CONTEXT_PHRASES = ("as i said", "like i mentioned", "as we discussed")
CLEAN_OPENERS = ("a", "an", "i", "the", "there", "we", "you")
SPONSOR_KEYWORDS = ("use code", "sponsored", "check out", "ad starts", "promo code", "discount code")
REACTION_PATTERN = r"(?i)\[(laughter|applause|laughs|cheering|crosstalk)\]"
HOOK_PATTERN = (
    r"(?i)\$[\d,]+|\d+%|\b(nobody|no\s+one)\s+(talks|knows)\b|\bthe\s+(truth|real\s+reason|problem)\b|\bi\s+(lost|made|quit|failed)\b"
    r"|\bhere'?s\s+(why|what|how)\b|\b(most|everyone)\s+(people|thinks)\b"
)
URL_PATTERN = r"(?i)^https?://(www\.|m\.)?(youtube\.com/(watch\?v=|shorts/|embed/)|youtu\.be/)"
WEB_PATTERN = r"(?i)^https?://[^\s/]+"
VIDEO_ID_PATTERN = r"(?:v=|youtu\.be/|shorts/)([A-Za-z0-9_-]{11})"
TIMESTAMP_PATTERN = r"\b(?:\d{1,2}:)?[0-5]?\d:[0-5]\d\b"
AMOUNT_PATTERN = r"\$[\d,]+(?:\.\d+)?"
PERCENT_PATTERN = r"\d+(?:\.\d+)?%"
INTEGER_PATTERN = r"\b\d+\b"
WORD_PATTERN = r"[a-z']+"
SENTENCE_END_PATTERN = r"(?<=[.?!])\s+"
STOP_PATTERN = r"[.?!]\s"
ENDED_PATTERN = r"[.?!]\s*$"
TAIL_PATTERN = r"[.,!?;:]+$"
CAPITAL_PATTERN = r"\b[A-Z][a-z]+\b"
STARTER_PATTERN = r"([A-Z][a-z]+)(?!\S)"
HEAD_PATTERN = r"^\s*"
AFTER_END_PATTERN = r"[.?!]\s+"
STAGES = ("downloading", "detecting", "editing", "captioning", "formatting")
TRANSITIONS = {
    "queued": ("downloading", "failed", "cancelled"), "downloading": ("detecting", "failed", "cancelled"), "detecting": ("editing", "failed", "cancelled"),
    "editing": ("captioning", "failed", "cancelled"), "captioning": ("formatting", "failed", "cancelled"), "formatting": ("complete", "failed", "cancelled"),
    "complete": (), "failed": ("queued",), "cancelled": (),
}


@dataclass(frozen=True)
class Weights:
    """Signal weights; a profile given in settings replaces these, it is not merged."""

    hook: float = 0.18
    coherence: float = 0.12
    sentiment: float = 0.20
    specificity: float = 0.15
    curiosity: float = 0.12
    audio_energy: float = 0.08
    laughter: float = 0.08
    dramatic_pause: float = 0.07


@dataclass(frozen=True)
class AudioWeights:
    """Weights where there is no transcript."""

    audio_energy: float = 0.45
    laughter: float = 0.35
    dramatic_pause: float = 0.20


@dataclass(frozen=True)
class Settings:
    window_min_s: float = 20.0
    window_max_s: float = 45.0
    window_step_s: float = 5.0
    anchor_step_s: float = 5.0
    min_clip_score: float = 0.45
    top_k: int = 6
    max_clips: int = 3
    max_clip_s: float = 60.0
    search_s: float = 10.0
    laughter_extend_s: float = 1.5
    laughter_reach_s: float = 3.0
    cluster_s: float = 15.0
    proximity_s: float = 5.0
    sponsor_ratio: float = 0.30
    sponsor_multiplier: float = 0.3
    social_cap: float = 0.65
    pause_min_s: float = 0.6
    video_limit_s: float = 21_600.0
    sponsor_keywords: tuple[str, ...] = SPONSOR_KEYWORDS
    weights: Weights = field(default_factory=Weights)
    audio_weights: AudioWeights = field(default_factory=AudioWeights)

    def overlay(self, values: dict[str, Any]) -> Settings:
        """Settings with the given keys; each is coerced to its default's type, unknown ones are passed over."""
        known = {f.name: getattr(self, f.name) for f in fields(self)}
        out: dict[str, Any] = {}
        for k, v in values.items():
            if k in ("weights", "audio_weights") and isinstance(v, dict):
                kind = Weights if k == "weights" else AudioWeights
                out[k] = kind(**{n: float(v[n]) for n in (f.name for f in fields(kind)) if n in v})
            elif k in known and v is not None:
                out[k] = tuple(v) if isinstance(known[k], tuple) else type(known[k])(v)
        return replace(self, **out)

    @staticmethod
    def from_yaml(path: str) -> Settings:
        """The ``detection`` part of a YAML file over the defaults; a missing file gives the defaults."""
        import yaml

        try:
            with open(path) as f:
                found = yaml.safe_load(f) or {}
        except FileNotFoundError:
            return Settings()
        return Settings().overlay(found.get("detection", found) or {})

    def lengths(self) -> list[float]:
        """Window lengths from the least by steps, the longest always among them."""
        n = int((self.window_max_s - self.window_min_s + 1e-9) // self.window_step_s) + 1
        out = [self.window_min_s + k * self.window_step_s for k in range(max(0, n))]
        return out if out and abs(out[-1] - self.window_max_s) <= 1e-9 else [*out, self.window_max_s]


DEFAULTS = Settings()
