"""Text signals and scalar text functions as Column expressions; every signal lies in [0, 1]."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelspan import settings as S

SENTENCE_END = S.SENTENCE_END_PATTERN


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where it is used inside a lambda or several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\x0b\x0c"))


def tokens(text: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def first_sentence(text: Column) -> Column:
    """Up to the first white space after a sentence's end; reads no further."""
    stop = F.regexp_instr(text, F.lit(S.STOP_PATTERN))
    head = strip(F.when(stop > 0, F.substring(text, F.lit(1), stop)).otherwise(text))
    return F.rtrim(head, F.lit(".?!"))


def first_word(sentence: Column) -> Column:
    return F.regexp_replace(F.lower(F.get(tokens(sentence), F.lit(0))), S.TAIL_PATTERN, "")


def hook_quality(sentence: Column) -> Column:
    def score(words: Column) -> Column:
        word = F.regexp_replace(F.lower(F.get(words, F.lit(0))), S.TAIL_PATTERN, "")
        base = F.lit(1.0) - F.when(word.isin(*S.BAD_STARTERS), 0.5).otherwise(0.0) - F.when(F.size(words) > 20, 0.2).otherwise(0.0)
        bonus = F.least(F.regexp_count(sentence, F.lit(S.HOOK_PATTERN)) * 0.2, F.lit(0.4))
        return F.when(F.size(words) == 0, 0.0).otherwise(clamp(base + bonus))

    return let(tokens(sentence), score)


def coherence(sentence: Column) -> Column:
    def score(low: Column) -> Column:
        word = F.regexp_replace(F.regexp_extract(low, r"^\S*", 0), S.TAIL_PATTERN, "")
        context = F.lit(False)
        for phrase in S.CONTEXT_PHRASES:
            context = context | low.startswith(phrase)
        return F.when(context, 0.1).when(low == "", 0.6).when(word.isin(*S.NEEDS_CONTEXT), 0.1).when(word.isin(*S.CLEAN_OPENERS), 0.8).otherwise(0.6)

    return let(F.lower(strip(sentence)), score)


def word_counts(text: Column, lexicon: Iterable[str] = S.EMOTION_WORDS) -> Column:
    """Words, and words of the lexicon."""
    words = list(lexicon)
    return let(F.regexp_extract_all(F.lower(text), F.lit(S.WORD_PATTERN), 0), lambda found: F.struct(F.size(found).alias("words"), F.size(F.filter(found, lambda w: w.isin(words))).alias("hits")))


def figure_count(text: Column) -> Column:
    """Amounts, percentages and integers."""
    return F.regexp_count(text, F.lit(S.AMOUNT_PATTERN)) + F.regexp_count(text, F.lit(S.PERCENT_PATTERN)) + F.regexp_count(text, F.lit(S.INTEGER_PATTERN))


def mark_count(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("?"), F.lit("")))


def text_counts(text: Column, lexicon: Iterable[str] = S.EMOTION_WORDS) -> Column:
    """Words, words of the lexicon, figures, question marks and reaction tags."""
    both = word_counts(text, lexicon)
    return let(both, lambda w: F.struct(w["words"].alias("words"), w["hits"].alias("hits"), figure_count(text).alias("figures"), mark_count(text).alias("marks"), reaction_count(text).alias("reactions")))


def sentiment_of(c: Column) -> Column:
    return F.when(c["words"] == 0, 0.0).otherwise(F.least(F.lit(1.0), c["hits"] / F.greatest(F.lit(1.0), c["words"] / F.lit(8.0))))


def sentiment(text: Column, lexicon: Iterable[str] = S.EMOTION_WORDS) -> Column:
    return let(word_counts(text, lexicon), sentiment_of)


def capitals(text: Column) -> Column:
    """Capitalised words, in order."""
    return F.regexp_extract_all(text, F.lit(S.CAPITAL_PATTERN), 0)


def unstarted(found: Column, starters: Column) -> Column:
    """The words of ``found`` that aren't among ``starters``."""
    return let(starters, lambda s: F.filter(found, lambda x: ~F.array_contains(s, x)))


def capitalised_terms(text: Column) -> Column:
    """Capitalised tokens that begin no sentence of the text."""
    return unstarted(capitals(text), F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?:{S.HEAD_PATTERN}|{S.AFTER_END_PATTERN}){S.STARTER_PATTERN}"), 1)))


def specificity_of(figures: Column, terms: Column) -> Column:
    return F.least(F.lit(1.0), (figures + terms) / F.lit(3.0))


def specificity(text: Column) -> Column:
    return specificity_of(figure_count(text), F.size(capitalised_terms(text)))


def opener_pattern(openers: Iterable[str] = S.QUESTION_OPENERS, begin: bool = True) -> str:
    """A question's first words after a sentence or a new line, and at the text's begin."""
    return rf"(?:{'^|' if begin else ''}{S.AFTER_END_PATTERN}|\n)\s*(?:{'|'.join(openers)})"


def curiosity_of(questions: Column, hits: Column) -> Column:
    return clamp((F.least(F.lit(1.0), questions / F.lit(3.0)) + F.least(F.lit(1.0), hits / F.lit(2.0))) / 2)


def curiosity(text: Column, phrases: Iterable[str] = S.HOOK_PHRASES, openers: Iterable[str] = S.QUESTION_OPENERS) -> Column:
    opened = F.regexp_count(F.lower(text), F.lit(opener_pattern(openers)))
    hits = let(F.lower(text), lambda x: sum((F.when(x.contains(p), 1).otherwise(0) for p in phrases), F.lit(0)))
    return curiosity_of(mark_count(text) + opened, hits)


def reaction_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(S.REACTION_PATTERN))


def laughter_of(reactions: Column) -> Column:
    return F.least(F.lit(1.0), reactions / F.lit(2.0))


def text_laughter(text: Column) -> Column:
    return laughter_of(reaction_count(text))


def ends_sentence(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(S.ENDED_PATTERN)


def parse_timestamps(text: Column) -> Column:
    """Seconds of every m:ss or h:mm:ss in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(S.TIMESTAMP_PATTERN), 0)
    return F.transform(found, lambda m: F.aggregate(F.transform(F.split(m, ":"), lambda p: p.cast("int")), F.lit(0), lambda acc, p: acc * 60 + p))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return out


def srt_time(seconds: Column) -> Column:
    ms = F.bround(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    part = lambda unit, n: F.floor(ms / unit) % n
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), part(60_000, 60), part(1000, 60), ms % 1000)


def clock(seconds: Column) -> Column:
    """mm:ss, truncating; minutes run past the hour."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def score_bar(score: Column, width: int = 20) -> Column:
    n = F.bround(clamp(score) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))


def escape_filter_path(path: Column) -> Column:
    return F.replace(F.replace(path, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:"))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def plural_message(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " clip found").otherwise(" clips found"))


def is_video_url(url: Column) -> Column:
    return F.coalesce(strip(url).rlike(S.URL_PATTERN), F.lit(False))


def is_web_url(url: Column) -> Column:
    return F.coalesce(strip(url).rlike(S.WEB_PATTERN), F.lit(False))


def video_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, S.VIDEO_ID_PATTERN, 1), F.lit(""))
