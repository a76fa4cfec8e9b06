"""DuckDB SQL that queries are held against: text functions as SQL expressions, relations as common tables."""

from __future__ import annotations

from reelspan import settings as S


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def strip(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"


def tokens(x: str) -> str:
    return rf"list_filter(string_split_regex(coalesce({x}, ''), '\s+'), lambda w: w <> '')"


def sentences(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1))"


def first_sentence(x: str) -> str:
    head = rf"string_split(regexp_replace({strip(x)}, '([.?!])\s+', '\1' || chr(1)), chr(1))[1]"
    return rf"regexp_replace({strip(head)}, '[.?!]+$', '')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern.replace(chr(39), chr(39) * 2)}'))"


def first_word(x: str) -> str:
    return rf"regexp_replace(lower(coalesce({tokens(x)}[1], '')), '[.,!?;:]+$', '')"


def clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def hook(x: str) -> str:
    score = f"1.0::DOUBLE - (CASE WHEN {first_word(x)} IN ({_list(S.BAD_STARTERS)}) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) - (CASE WHEN len({tokens(x)}) > 20 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)"
    return f"CASE WHEN len({tokens(x)}) = 0 THEN 0.0::DOUBLE ELSE {clamp(f'{score} + least({count(x, S.HOOK_PATTERN)} * 0.2::DOUBLE, 0.4::DOUBLE)')} END"


def coherence(x: str) -> str:
    phrases = " OR ".join(f"starts_with(lower({strip(x)}), '{p}')" for p in S.CONTEXT_PHRASES)
    return f"CASE WHEN {phrases} THEN 0.1::DOUBLE WHEN len({tokens(x)}) = 0 THEN 0.6::DOUBLE WHEN {first_word(x)} IN ({_list(S.NEEDS_CONTEXT)}) THEN 0.1::DOUBLE WHEN {first_word(x)} IN ({_list(S.CLEAN_OPENERS)}) THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END"


def sentiment(x: str, lexicon=S.EMOTION_WORDS) -> str:
    found = f"regexp_extract_all(lower({x}), '[a-z'']+')"
    return f"CASE WHEN len({found}) = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, len(list_filter({found}, lambda w: w IN ({_list(lexicon)})))::DOUBLE / greatest(1.0::DOUBLE, len({found}) / 8.0::DOUBLE)) END"


def capitalised(x: str) -> str:
    starters = f"list_transform({sentences(strip(x))}, lambda s: {tokens('s')}[1])"
    return rf"list_filter(list_filter(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[A-Z][a-z]+')), lambda t: NOT list_contains({starters}, t))"


def specificity(x: str) -> str:
    numbers = rf"len(list_filter(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[0-9]+')))"
    return rf"least(1.0::DOUBLE, ({count(x, chr(92) + '$[' + chr(92) + 'd,]+(?:' + chr(92) + '.' + chr(92) + 'd+)?')} + {count(x, chr(92) + 'd+(?:' + chr(92) + '.' + chr(92) + 'd+)?%')} + {numbers} + len({capitalised(x)})) / 3.0::DOUBLE)"


def curiosity(x: str) -> str:
    marks = f"(length({x}) - length(replace({x}, '?', '')))"
    parts = rf"string_split(replace(regexp_replace({x}, '([.?!])\s+', '\1' || chr(1), 'g'), chr(10), chr(1)), chr(1))"
    opened = f"len(list_filter({parts}, lambda s: regexp_matches(lower({strip('s')}), '^({'|'.join(S.QUESTION_OPENERS)})')))"
    hits = " + ".join(f"(CASE WHEN contains(lower({x}), '{p.replace(chr(39), chr(39) * 2)}') THEN 1 ELSE 0 END)" for p in S.HOOK_PHRASES)
    return clamp(f"(least(1.0::DOUBLE, ({marks} + {opened}) / 3.0::DOUBLE) + least(1.0::DOUBLE, ({hits}) / 2.0::DOUBLE)) / 2")


def laughter(x: str) -> str:
    return f"least(1.0::DOUBLE, {count(x, S.REACTION_PATTERN)} / 2.0::DOUBLE)"


def ends_sentence(x: str) -> str:
    return rf"regexp_matches(coalesce({x}, ''), '[.?!]\s*$')"


def content(w=S.Weights()) -> str:
    return clamp(f"hook * {w.hook}::DOUBLE + coherence * {w.coherence}::DOUBLE + sentiment * {w.sentiment}::DOUBLE + specificity * {w.specificity}::DOUBLE + curiosity * {w.curiosity}::DOUBLE + 0.0::DOUBLE + laughter * {w.laughter}::DOUBLE + 0.0::DOUBLE")


def signal_columns(text: str, first: str) -> str:
    return f"{hook(first)} AS hook, {coherence(first)} AS coherence, {sentiment(text)} AS sentiment, {specificity(text)} AS specificity, {curiosity(text)} AS curiosity, {laughter(text)} AS laughter"


#: Each relation's common tables; a query names those it needs, in order.
SEGMENTS = rf"""
seg0 AS (SELECT doc_id AS video_id, unnest(range(len(p))) AS seg_idx, unnest(p) AS text FROM (SELECT doc_id, {sentences(strip('text'))} AS p FROM documents)),
seg1 AS (SELECT *, len({tokens('text')}) * 0.5::DOUBLE AS length FROM seg0),
seg AS (SELECT video_id, seg_idx::INTEGER AS seg_idx, text, sum(length) OVER (PARTITION BY video_id ORDER BY seg_idx) - length AS start, sum(length) OVER (PARTITION BY video_id ORDER BY seg_idx) AS "end" FROM seg1)"""
TURNS = SEGMENTS[: SEGMENTS.index("seg0 AS")] + "seg0 AS (SELECT conv_id AS video_id, turn AS seg_idx, coalesce(text, '') AS text FROM conversations)," + SEGMENTS[SEGMENTS.index("seg1 AS") - 1 :]
_ORDERED = """
sego AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start, seg_idx) - 1 AS anchor, max("end") OVER (PARTITION BY video_id) AS timeline_end FROM seg)"""
WINDOWS = SEGMENTS + "," + _ORDERED + f""",
win AS (SELECT video_id, anchor, len_idx, start AS start_s, start + length AS end_s, timeline_end FROM sego,
  (SELECT unnest(range({len(S.DEFAULTS.lengths())})) AS len_idx, unnest([{', '.join(f'{x}::DOUBLE' for x in S.DEFAULTS.lengths())}]) AS length)
  WHERE start + length <= timeline_end + 1e-9)"""
WINDOW_TEXT = WINDOWS + """,
wt AS (SELECT w.video_id, w.anchor, w.len_idx, any_value(w.start_s) AS start_s, any_value(w.end_s) AS end_s, any_value(w.timeline_end) AS timeline_end,
  string_agg(s.text, ' ' ORDER BY s.start, s.seg_idx) AS text FROM win w JOIN seg s ON s.video_id = w.video_id AND s.start < w.end_s AND s."end" > w.start_s GROUP BY ALL)"""
SCORED = WINDOW_TEXT + f""",
wf AS (SELECT *, {first_sentence('text')} AS f FROM wt),
ws AS (SELECT *, {signal_columns('text', 'f')} FROM wf),
sc AS (SELECT video_id, anchor, len_idx, start_s, end_s, timeline_end, round({content()}, 9) AS score FROM ws)"""


def greedy(source: str, k: int, name: str) -> str:
    """Greedy selection from ``source`` (video_id, n, start_s, end_s), n being the order from 1; the rows of ``name``
    with n > 0 are those kept."""
    return f"""
{name} AS (
  SELECT video_id, 0::BIGINT AS n, []::STRUCT(a DOUBLE, e DOUBLE)[] AS kept FROM (SELECT DISTINCT video_id FROM {source})
  UNION ALL
  SELECT c.video_id, c.n, list_append(x.kept, {{'a': c.start_s, 'e': c.end_s}}) FROM (
    SELECT g.video_id, g.kept, min(c.n) AS m FROM {name} g JOIN {source} c ON c.video_id = g.video_id AND c.n > g.n
    WHERE len(g.kept) < {k} AND len(list_filter(g.kept, lambda h: c.start_s < h.e AND c.end_s > h.a)) = 0 GROUP BY g.video_id, g.kept) x
  JOIN {source} c ON c.video_id = x.video_id AND c.n = x.m)"""


COMMENTS = r"""
com0 AS (SELECT user_id AS video_id, event_id AS comment_id, event_type, (CAST(floor(epoch(ts)) AS BIGINT) % 180 + 180) % 180 AS s FROM events),
com AS (SELECT video_id, comment_id, event_type || ' at ' || (s // 60)::VARCHAR || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS text FROM com0),
men0 AS (SELECT video_id, comment_id, text, unnest(regexp_extract_all(text, '\b(?:\d{1,2}:)?[0-5]?\d:[0-5]\d\b')) AS m FROM com),
men AS (SELECT video_id, comment_id, text, CASE len(string_split(m, ':')) WHEN 2 THEN split_part(m, ':', 1)::INT * 60 + split_part(m, ':', 2)::INT
  ELSE split_part(m, ':', 1)::INT * 3600 + split_part(m, ':', 2)::INT * 60 + split_part(m, ':', 3)::INT END AS ts FROM men0)"""
CLUSTERS = COMMENTS + """,
anc AS (SELECT video_id, min(ts) AS a FROM men GROUP BY video_id
  UNION ALL SELECT m.video_id, min(m.ts) FROM anc JOIN men m ON m.video_id = anc.video_id AND m.ts > anc.a + 15 GROUP BY m.video_id, anc.a),
clu AS (SELECT video_id, avg(ts) AS center_s, min(ts)::DOUBLE AS start_s, max(ts)::DOUBLE AS end_s, count(*) AS "count" FROM (
  SELECT m.video_id, m.ts, m.comment_id, max(a) AS a FROM men m JOIN anc ON anc.video_id = m.video_id AND anc.a <= m.ts GROUP BY ALL) GROUP BY video_id, a)"""
GRID = """
grid AS (SELECT video_id, (k * 20)::DOUBLE AS start_s, (k * 20 + 20)::DOUBLE AS end_s FROM (SELECT c.video_id, unnest(range(coalesce(max(m.ts), 0) // 20 + 1)) AS k
  FROM com c LEFT JOIN men m ON m.video_id = c.video_id AND m.comment_id = c.comment_id GROUP BY c.video_id))"""
FRAMES = """
fr0 AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, value AS rms, coalesce((props::JSON->>'$.k')::DOUBLE / 100, 0) AS zcr0 FROM events),
fr AS (SELECT video_id, frame_idx, frame_idx * 4.0::DOUBLE AS t, rms, CASE WHEN max(rms) OVER w > 0 THEN rms / max(rms) OVER w ELSE 0 END AS energy,
  CASE WHEN max(zcr0) OVER w > 0 THEN zcr0 / max(zcr0) OVER w ELSE 0 END AS zcr FROM fr0 WINDOW w AS (PARTITION BY video_id))"""
GAPS = FRAMES + """,
flo AS (SELECT video_id, greatest(quantile_cont(rms, 0.1), 1e-5) AS floor, max(t) AS last_t FROM fr GROUP BY video_id),
sil AS (SELECT f.*, f.rms <= floor AS silent, coalesce(lead(t) OVER (PARTITION BY f.video_id ORDER BY t), last_t) AS next_t FROM fr f JOIN flo USING (video_id)),
run AS (SELECT *, sum(CASE WHEN silent THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY t) AS g FROM sil),
gap AS (SELECT video_id, min(t) AS gap_start, max(next_t) AS gap_end, (min(t) + max(next_t)) / 2 AS mid FROM run WHERE silent GROUP BY video_id, g HAVING max(next_t) - min(t) >= 0.6)"""
AUDIO_GRID = GAPS + """,
agrid AS (SELECT video_id, (k * 40)::DOUBLE AS start_s, (k * 40 + 40)::DOUBLE AS end_s FROM (SELECT video_id, last_t, unnest(range(floor(last_t / 40)::BIGINT + 1)) AS k FROM (SELECT video_id, max(t) AS last_t FROM fr GROUP BY video_id)) WHERE k * 40 <= last_t)"""


def audio_features(source: str, name: str) -> str:
    """``name``: the windows of ``source`` (video_id, start_s, end_s, ...) with energy, laugh and pause by their audio."""
    mean = lambda x: clamp(f"round(coalesce({x}, 0), 12)")
    return f"""
{name}_a AS (SELECT w.*, {mean('avg(f.energy)')} AS energy, {mean('avg(f.energy * f.zcr)')} AS laugh FROM {source} w LEFT JOIN fr f ON f.video_id = w.video_id AND f.t >= w.start_s AND f.t < w.end_s GROUP BY ALL),
{name}_p AS (SELECT w.video_id, w.start_s, w.end_s, least(1.0::DOUBLE, count(*) / 3.0::DOUBLE) AS pause FROM (SELECT DISTINCT video_id, start_s, end_s FROM {source}) w
  JOIN gap p ON p.video_id = w.video_id AND p.mid >= w.start_s - {S.DEFAULTS.pause_min_s} AND p.mid < w.end_s GROUP BY ALL),
{name} AS (SELECT a.*, coalesce(p.pause, 0)::DOUBLE AS pause FROM {name}_a a LEFT JOIN {name}_p p ON p.video_id = a.video_id AND p.start_s = a.start_s AND p.end_s = a.end_s)"""


def audio_content() -> str:
    w = S.DEFAULTS.audio_weights
    return clamp(f"energy * {w.audio_energy}::DOUBLE + laugh * {w.laughter}::DOUBLE + pause * {w.dramatic_pause}::DOUBLE")


def full_content() -> str:
    """The content score of text signals and audio together."""
    w = S.DEFAULTS.weights
    text = " + ".join(f"{n} * {getattr(w, n)}::DOUBLE" for n in ("hook", "coherence", "sentiment", "specificity", "curiosity"))
    return clamp(f"{text} + energy * {w.audio_energy}::DOUBLE + greatest(laughter, laugh) * {w.laughter}::DOUBLE + pause * {w.dramatic_pause}::DOUBLE")


def social_fused(source: str, name: str, keyword: str) -> str:
    """``name``: the windows of ``source`` (video_id, start_s, end_s, content, ...) with the score that the comments make of their content."""
    d = S.DEFAULTS
    return f"""
{name}_w AS (SELECT DISTINCT video_id, start_s, end_s FROM {source}),
{name}_s AS (SELECT w.*, max(c.count) AS best FROM {name}_w w JOIN clu c ON c.video_id = w.video_id AND c.center_s BETWEEN w.start_s AND w.end_s GROUP BY ALL),
{name}_v AS (SELECT video_id, max(count) AS most, least({d.social_cap}::DOUBLE, 0.2::DOUBLE + sum(count) / 50.0::DOUBLE * 0.45::DOUBLE) AS conf FROM clu GROUP BY video_id),
{name}_m AS (SELECT w.*, count(DISTINCT m.comment_id) AS n, count(DISTINCT CASE WHEN contains(lower(m.text), '{keyword}') THEN m.comment_id END) AS s
  FROM {name}_w w JOIN men m ON m.video_id = w.video_id AND m.ts BETWEEN w.start_s - {d.proximity_s} AND w.end_s + {d.proximity_s} GROUP BY ALL),
{name} AS (SELECT x.* EXCLUDE (content), round({clamp(f"(least(1.0::DOUBLE, coalesce(s.best / v.most, 0)) * coalesce(v.conf, 0) + x.content * (1.0::DOUBLE - coalesce(v.conf, 0))) * (CASE WHEN m.s::DOUBLE / m.n > {d.sponsor_ratio}::DOUBLE THEN {d.sponsor_multiplier}::DOUBLE ELSE 1.0::DOUBLE END)")}, 9) AS score
  FROM {source} x LEFT JOIN {name}_v v ON v.video_id = x.video_id LEFT JOIN {name}_s s ON s.video_id = x.video_id AND s.start_s = x.start_s AND s.end_s = x.end_s
  LEFT JOIN {name}_m m ON m.video_id = x.video_id AND m.start_s = x.start_s AND m.end_s = x.end_s)"""


def audio_final(keyword: str | None = None, where: str = "true") -> str:
    """Detection by audio alone, after GAPS (with a keyword also CLUSTERS): windows by steps, the best six, edges at the nearest silence,
    and the best three of these anew (``alast`` and ``afin``)."""

    def scored(source: str, name: str) -> str:
        found = audio_features(source, f"{name}_f") + ","
        made = f"{audio_content()} AS content FROM {name}_f)"
        if keyword is None:
            return found + f"\n{name} AS (SELECT * EXCLUDE (energy, laugh, pause, content), round(content, 9) AS score FROM (SELECT *, {made})"
        return found + f"\n{name}_c AS (SELECT * EXCLUDE (energy, laugh, pause), {made}," + social_fused(f"{name}_c", name, keyword)

    head = f"""
aend AS (SELECT video_id, max(t) AS timeline_end FROM fr WHERE {where} GROUP BY video_id),
astep AS (SELECT video_id, timeline_end, unnest(range(floor(timeline_end / 5)::BIGINT + 1)) AS anchor FROM aend),
awin AS (SELECT video_id, timeline_end, anchor, len_idx, (anchor * 5)::DOUBLE AS start_s, anchor * 5 + length AS end_s FROM astep,
  (SELECT unnest(range({len(S.DEFAULTS.lengths())})) AS len_idx, unnest([{', '.join(f'{x}::DOUBLE' for x in S.DEFAULTS.lengths())}]) AS length) WHERE anchor * 5 + length <= timeline_end + 1e-9),"""
    moved = """,
atop AS (SELECT s.* FROM akept JOIN asrc s USING (video_id, n)),
aedge AS (SELECT video_id, n, 0 AS e, start_s AS at FROM atop UNION ALL SELECT video_id, n, 1, end_s FROM atop),
anear AS (SELECT t.video_id, t.n, t.e, any_value(t.at) AS at, coalesce(min_by(p.mid, {'d': abs(p.mid - t.at), 'm': p.mid}), any_value(t.at)) AS v
  FROM aedge t LEFT JOIN gap p ON p.video_id = t.video_id AND p.mid >= greatest(0, t.at - 10) AND p.mid < t.at + 10 GROUP BY t.video_id, t.n, t.e),
amove AS (SELECT t.video_id, t.n AS n0, t.start_s AS s0, t.end_s AS e0, greatest(0, a.v) AS ca, least(t.timeline_end, b.v) AS ce FROM atop t
  JOIN anear a ON a.video_id = t.video_id AND a.n = t.n AND a.e = 0 JOIN anear b ON b.video_id = t.video_id AND b.n = t.n AND b.e = 1),
aref0 AS (SELECT video_id, n0, CASE WHEN ce <= ca THEN s0 ELSE ca END AS start_s, CASE WHEN ce <= ca THEN e0 ELSE ce END AS e FROM amove),
aref AS (SELECT video_id, n0, start_s, least(e, start_s + 60) AS end_s FROM aref0),"""
    src = ",\nasrc AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, start_s, anchor, len_idx) AS n FROM ascore WHERE score >= 0.2),"
    fin = ",\nafin AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, start_s, n0) AS n FROM afin0),"
    return head + scored("awin", "ascore") + src + greedy("asrc", 6, "akept") + moved + scored("aref", "afin0") + fin + greedy("afin", 3, "alast")


WORDS = f"""
wrd AS (SELECT doc_id AS video_id, unnest(range(len(w))) AS word_idx, unnest(w) AS word FROM (SELECT doc_id, {tokens('text')} AS w FROM documents)),
lin AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY word_idx // 6)::INTEGER AS line_no, min(word_idx) * 0.5::DOUBLE AS start_s, (max(word_idx) + 1) * 0.5::DOUBLE AS end_s, string_agg(word, ' ' ORDER BY word_idx) AS text FROM wrd GROUP BY video_id, word_idx // 6)"""


def srt_time(x: str) -> str:
    ms = f"round_even(greatest({x}, 0) * 1000, 0)::BIGINT"
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


JOBS = """
job AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'complete' WHEN 'P' THEN 'downloading' END AS state, o_orderdate AS submitted_at,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE ['downloading', 'detecting', 'editing', 'captioning', 'formatting'][o_orderkey % 5 + 1] END AS last_stage_completed FROM orders)"""
CLIPS = """
clip AS (SELECT l_orderkey AS job_id, l_linenumber AS clip_no, l_quantity AS start_s, l_quantity + 10 + l_linenumber * 5 AS end_s, l_discount * 10 AS score, l_returnflag AS flag FROM lineitem)"""


def sql(tables: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{tables.strip()} {select}"
