"""DuckDB SQL for the queries that SQL can express, with the same columns."""

from __future__ import annotations

from tidemark.functions.text import WEIGHTS

TOKEN = "[0-9A-Za-z]+|[\\x{4e00}-\\x{9fff}]{2,}"
WEIGHT = "CASE" + "".join(f" WHEN {{0}} = '{t}' THEN {w}" for t, w in WEIGHTS.items()) + " ELSE 1.0 END"


def tokens(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '{TOKEN}'), lambda x: length(x) >= 2))"


def squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, '[\\s\\p{{Z}}\\x{{85}}\\x0b\\x1c-\\x1f]+', ' ', 'g'))"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL OR len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def hms(s: str) -> str:
    return f"lpad((({s}) // 3600)::VARCHAR, 2, '0') || ':' || lpad(((({s}) % 3600) // 60)::VARCHAR, 2, '0') || ':' || lpad((({s}) % 60)::VARCHAR, 2, '0')"


QUALITY = f"""SELECT doc_id, CASE WHEN n = '' THEN 0.0 ELSE (length(n) + 8 * len(regexp_extract_all(n, '{TOKEN}')) - 2 * length(regexp_replace(n, '[\\p{{L}}\\p{{N}} \\-_/.:,;()\\[\\]{{}}+*=%]', '', 'g')))::DOUBLE END AS quality FROM (SELECT doc_id, {squeeze("coalesce(text, '')")} AS n FROM documents)"""
UTTER = f"""SELECT conv_id AS stream_id, turn + 1 AS "index", turn::DOUBLE * 20 AS "start", turn::DOUBLE * 20 + 20 AS "end", t AS text FROM (SELECT *, {squeeze("coalesce(text, '')")} AS t FROM conversations) WHERE t <> ''"""
FRAMES = "SELECT *, change_ratio * (event_id % 10) / 20 AS component_ratio, change_ratio * 50 AS scene_score, substr(md5(event_type), 1, 16) AS phash FROM (SELECT user_id AS stream_id, event_id, event_type, value / 500 AS change_ratio, concat_ws(' ', event_type, props) AS ocr_text, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9::DOUBLE AS ts FROM events)"
PAGE_FRAMES = f"""SELECT *, change_ratio * 60 AS scene_score FROM (SELECT doc_id // 10 AS stream_id, doc_id AS event_id, ((doc_id % 10) * 16)::DOUBLE AS ts, ((doc_id * 7919) % 1000) / 4000 AS change_ratio, ((doc_id * 104729) % 100) / 2000 AS component_ratio, substr(md5((doc_id // 2)::VARCHAR), 1, 16) AS phash, {squeeze("substr(coalesce(text, ''), 1, 160)")} AS ocr_text FROM documents)"""


def point(text: str) -> str:
    return f"regexp_replace({squeeze(text)}, '^[ ,，、]+|[ ,，、]+$', '', 'g')"


def sentences(text: str) -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({text}, ''), '[。！？；\\n]+'), lambda s: {point('s')}), lambda s: length(s) >= 6)"


SENTENCES = f"SELECT doc_id, {sentences('text')} AS s FROM documents"
WEAK = f"""SELECT stream_id, "at", duration, min(change_ratio) < 0.02 AS weak FROM (SELECT stream_id, floor(ts)::BIGINT AS "at", change_ratio, max(ts) OVER (PARTITION BY stream_id) AS duration FROM ({FRAMES})) GROUP BY stream_id, "at", duration"""
#: The greedy fold over utterances; extra counts what joined after a limit was passed.
SEGMENTS = f"""WITH RECURSIVE u AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY "start", "index") AS k, regexp_matches(trim(text), '[。！？!?；;.](["''”’)\\]]+)?$') AS ends FROM ({UTTER})),
f AS (SELECT stream_id, k, "index", "start", "end", text, ends, 1 AS g, length(text) AS chars, "start" AS begun, -1 AS extra FROM u WHERE k = 1
UNION ALL SELECT stream_id, k, "index", "start", "end", text, ends, CASE WHEN stays THEN g ELSE g + 1 END, CASE WHEN stays THEN size ELSE length(text) END, CASE WHEN stays THEN begun ELSE "start" END, CASE WHEN NOT stays THEN -1 WHEN extra >= 0 THEN extra + 1 ELSE -1 END FROM (
  SELECT *, extra < 0 OR (extra < 2 AND NOT ended AND size <= 400 AND "end" - begun <= 180) AS stays FROM (
    SELECT n.stream_id, n.k, n."index", n."start", n."end", n.text, n.ends, f.ends AS ended, f.g, f.begun, f.chars + length(n.text) + 1 AS size, CASE WHEN f.extra < 0 AND (f.chars + length(n.text) + 1 > 280 OR n."end" - f.begun > 150) THEN 0 ELSE f.extra END AS extra FROM f JOIN u n ON n.stream_id = f.stream_id AND n.k = f.k + 1)))
SELECT stream_id, g::INT AS segment_number, 'segment_' || lpad(g::VARCHAR, 3, '0') AS segment_id, min("start") AS "start", arg_max("end", k) AS "end", string_agg("index"::VARCHAR, ',' ORDER BY k) AS segment_indexes, string_agg(text, ' ' ORDER BY k) AS text FROM f GROUP BY stream_id, g"""


def shared(a: str, b: str) -> str:
    """Token weight of what two lists share."""
    return f"coalesce(list_sum(list_transform(list_intersect({a}, {b}), lambda x: ({WEIGHT.format('x')})::DOUBLE)), 0.0)"


DOC_REVIEWS = f"SELECT l.doc_id AS segment_id, coalesce(s.s[1], '') AS summary, CASE WHEN quality = 1 THEN 'done' ELSE 'pending' END AS status FROM labels l JOIN ({SENTENCES}) s USING (doc_id)"
DONE = f"SELECT segment_id FROM ({DOC_REVIEWS}) WHERE trim(summary) <> '' AND status = 'done'"


def frame_score(text: str) -> str:
    return f"CASE WHEN {squeeze(text)} = '' THEN 0.0 ELSE (length({squeeze(text)}) + 8 * len(regexp_extract_all({squeeze(text)}, '{TOKEN}')) - 2 * length(regexp_replace({squeeze(text)}, '[\\p{{L}}\\p{{N}} \\-_/.:,;()\\[\\]{{}}+*=%]', '', 'g')))::DOUBLE END"


BY_TIME = "(PARTITION BY stream_id ORDER BY ts, event_id)"


def kinds(frames: str) -> str:
    """Every frame against the one before; the reference's rules 0.02, 0.12, 0.08 with 0.02, five frames back, 0.82."""
    zero = ", ".join(f"CASE WHEN n = 1 THEN 0.0 ELSE {c} END AS {c}" for c in ("change_ratio", "component_ratio", "scene_score"))
    return f"""SELECT *, CASE WHEN lead(change_kind) OVER {BY_TIME} = 'page_change' THEN 'stable_before_change' WHEN n = 1 THEN 'opening_frame' WHEN later IS NULL THEN 'closing_frame' ELSE '' END AS reason FROM (
  SELECT *, CASE WHEN n > 1 AND stable AND similarity < 0.82 AND (change_ratio >= 0.12 OR (change_ratio >= 0.08 AND component_ratio >= 0.02)) THEN 'page_change' WHEN change_ratio >= 0.02 THEN 'annotation_like_change' ELSE 'no_change' END AS change_kind FROM (
    SELECT *, NOT coalesce(bool_or(change_ratio >= 0.02) OVER (PARTITION BY stream_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), false) AS stable FROM (
      SELECT * REPLACE ({zero}), CASE WHEN n = 1 THEN 0.0 ELSE {jaccard("before", "t")} END AS similarity FROM (
        SELECT *, row_number() OVER w AS n, lag(t) OVER w AS before, lead(event_id) OVER w AS later FROM (SELECT *, {tokens("ocr_text")} AS t FROM ({frames})) WINDOW w AS {BY_TIME}))))"""


def clusters(frames: str) -> str:
    return f"""SELECT *, sum(fresh) OVER {BY_TIME}::BIGINT AS cluster FROM (
  SELECT *, CASE WHEN last_id IS NULL OR (list_sum(list_transform(range(1, 17), lambda i: CASE WHEN phash[i] <> last_h[i] THEN 1 ELSE 0 END)) > 6 AND {jaccard("last_t", "t")} < 0.7) THEN 1 ELSE 0 END AS fresh FROM (
    SELECT *, lag(event_id) OVER w AS last_id, lag(phash) OVER w AS last_h, lag(t) OVER w AS last_t FROM (SELECT * EXCLUDE (t), t FROM (SELECT *, {tokens("ocr_text")} AS t FROM ({frames}))) WINDOW w AS {BY_TIME}))"""


def best_frames(found: str) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, cluster ORDER BY score DESC, off, ts, event_id) AS r FROM (SELECT *, {frame_score("ocr_text")} + 10 * len(t) + scene_score AS score, round(abs(ts - avg(ts) OVER (PARTITION BY stream_id, cluster)), 9) AS off FROM ({found}))) WHERE r = 1"""


def rollup(found: str) -> str:
    return f"""SELECT stream_id, cluster, min(ts) AS "start", max(ts) AS "end", count(*) AS frame_count, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS frames FROM ({found}) GROUP BY ALL"""


def visual_units(frames: str) -> str:
    """First, candidates (both ends among them) and last frames, one a time; clusters; the representative of each."""
    pages = f"SELECT * EXCLUDE (t) FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, ts ORDER BY event_id) AS same FROM ({kinds(frames)}) WHERE reason <> '') WHERE same = 1"
    found = clusters(pages)
    low = "quality < 25 OR length(ocr_text) < 20 OR len(list_filter(t, lambda x: x NOT IN ('transformer', 'bert'))) < 2 OR (len(t) <= 2 AND length(ocr_text) < 30)"
    return f"""SELECT stream_id, cluster::INT AS unit_number, 'visual_unit_' || lpad(cluster::VARCHAR, 3, '0') AS unit_id, r."start", r."end", r.frame_count, r.frames, b.event_id, b.ts, b.ocr_text, length(b.ocr_text) AS ocr_len, quality, b.change_kind, b.reason <> '' AS candidate, b.t AS ut, {low} AS low
FROM ({rollup(found)}) r JOIN (SELECT *, {frame_score("ocr_text")} AS quality FROM ({best_frames(found)})) b USING (stream_id, cluster)"""


UNITS = visual_units(PAGE_FRAMES)
LINE = "[^\\s\\p{Z}A-Za-z0-9+\\-_=:/%()\\[\\]{}.,<>*|\\x{4e00}-\\x{9fff}αβγδθλμστφψωℎ]"
BROKEN = "[ǍǓǗǝǜƲƭƹ]"


def slide_text(text: str) -> str:
    words = f"list_filter(list_transform(string_split({squeeze(text)}, ' '), lambda t: regexp_replace(t, '[\\p{{M}}\\p{{Cf}}]', '', 'g')), lambda t: t <> '' AND length(regexp_replace(t, '{LINE}', '', 'g')) >= 0.85 * length(t) AND NOT regexp_matches(t, '{BROKEN}'))"
    return f"regexp_replace({squeeze(f"array_to_string({words}, ' ')")}, '\\s+([,.;:，。；：、])', '\\1', 'g')"


def noise(text: str) -> str:
    return f"(trim({text}) <> '' AND (regexp_matches({text}, '[ǍǓǗǝǜƲƭƹ\\x{{05a9}}]') OR length(regexp_replace({text}, '{LINE.replace('[^', '[', 1)}', '', 'g')) >= 2))"


def page_title(text: str, index: str) -> str:
    single = lambda i: f"regexp_full_match(w[{i}], '[\\x{{4e00}}-\\x{{9fff}}A-Za-z]')"
    end = f"list_filter(range(3, len(w) + 1), lambda i: {single('i')} AND {single('i - 1')} AND {single('i - 2')})[1]"
    before = f"array_to_string(CASE WHEN {end} IS NULL THEN w ELSE w[1:{end} - 1] END, ' ')"
    scattered = "len(w) >= 4 AND length(w[1]) BETWEEN 4 AND 40 AND len(list_filter(w[2:], lambda x: length(x) <= 2)) >= 3"
    title = f"list_transform([string_split_regex(line, '\\s+')], lambda w: CASE WHEN {scattered} THEN w[1] WHEN length({before}) BETWEEN 2 AND 40 THEN {before} END)[1]"
    lines = f"list_filter(list_transform(string_split_regex({text}, '[\\n|·•]+'), lambda x: trim(x)), lambda x: x <> '')"
    return f"coalesce(list_filter(list_transform({lines}, lambda line: CASE WHEN length(line) BETWEEN 2 AND 80 AND NOT {noise('line')} THEN {title} END), lambda x: x IS NOT NULL)[1], 'Slide ' || {index})"


LOW_PAGE = "(length(text) < 8 OR lower(title) IN ('contents', '目录', 'slide') OR contains(title, '目录'))"
RAW_SLIDES = f"""SELECT *, {LOW_PAGE} AS low FROM (SELECT *, {page_title("text", "slide_index")} AS title FROM (
SELECT doc_id // 50 AS deck, (doc_id % 50 + 1)::INT AS slide_index, {squeeze("array_to_string(list_transform(string_split(coalesce(text, ''), chr(10))[1:3], lambda x: trim(substr(x, 1, 80))), ' | ')")} AS text FROM documents))"""
SLIDES = f"""SELECT *, {LOW_PAGE} AS low FROM (SELECT deck, slide_index, text, CASE WHEN kept = '' OR {noise("kept")} OR lower(kept) LIKE 'slide %' THEN {page_title("text", "slide_index")} ELSE kept END AS title FROM (
SELECT deck, slide_index, text, CASE WHEN own = '' THEN 'Slide ' || slide_index ELSE {page_title("own", "slide_index")} END AS kept FROM (SELECT deck, slide_index, {slide_text("text")} AS text, {slide_text("title")} AS own FROM ({RAW_SLIDES}))))"""
HINTS = f"""SELECT stream_id, segment_number, segment_id, list(ocr_text ORDER BY r) AS hints FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, segment_number ORDER BY first_ts, first_id) AS r FROM (
SELECT s.stream_id, segment_number, segment_id, trim(ocr_text) AS ocr_text, min(ts) AS first_ts, arg_min(event_id, (ts, event_id)) AS first_id FROM ({SEGMENTS}) s JOIN ({PAGE_FRAMES}) f ON f.stream_id = s.stream_id AND ts >= "start" - 5 AND ts <= "end" + 5 WHERE trim(ocr_text) <> '' GROUP BY ALL)) WHERE r <= 3 GROUP BY ALL"""
#: Reviews and cleaned texts as the query makes them.
REVIEWED = f"""SELECT *, coalesce({sentences("text")}[1], '') AS summary, CASE WHEN segment_number % 4 = 0 THEN 'check names' ELSE '' END AS issues, CASE WHEN segment_number % 3 <> 0 THEN trim(replace(text, ',', '')) ELSE '' END AS cleaned, CASE WHEN (stream_id + segment_number) % 7 = 0 THEN 'pending' ELSE 'done' END AS status FROM ({SEGMENTS})"""
SCORED = f"""SELECT *, {tokens("summary || ' ' || issues || ' ' || body || ' ' || text || ' ' || hint")} AS t, summary || ' ' || body || ' ' || text AS bundle, ("start" + "end") / 2 AS centre,
CASE WHEN stream_id % 2 = 0 AND deck IN (SELECT deck FROM ({RAW_SLIDES})) THEN 'slides-first' ELSE 'video-first' END AS source_mode FROM (
SELECT r.*, CASE WHEN cleaned = '' THEN trim(text) ELSE cleaned END AS body, coalesce(array_to_string(hints, ' '), '') AS hint, r.stream_id % 20 AS deck FROM ({REVIEWED}) r LEFT JOIN ({HINTS}) h USING (stream_id, segment_number) WHERE status = 'done' AND trim(summary) <> '')"""
PART = "(PARTITION BY stream_id, segment_number)"


def ranked(rows: str, order: str, most: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, segment_number ORDER BY {order})::INT AS "rank" FROM ({rows})) WHERE "rank" <= {most}"""


UNIT_SCORE = "10 * w - away / 10 - CASE WHEN low THEN 8.0 ELSE 0.0 END"
BEST_FIRST = "score DESC, away, unit_number"


def unit_pairs(segments: str) -> str:
    return f"SELECT s.stream_id, segment_number, s.segment_id, unit_number, unit_id, low, abs(ts - centre) AS away, {shared('t', 'ut')} AS w FROM ({segments}) s JOIN ({UNITS}) v USING (stream_id)"


def near_units(segments: str) -> str:
    rows = f"SELECT *, {UNIT_SCORE} AS score, bool_or(w > 0) OVER {PART} AS any_text, bool_or(NOT low) OVER {PART} AS any_good FROM ({unit_pairs(segments)}) WHERE away <= 45"
    return ranked(f"SELECT * FROM ({rows}) WHERE (score > 0 OR w > 0) AND (NOT any_text OR w > 0) AND (NOT any_good OR NOT low)", BEST_FIRST, 5)


def global_units(segments: str) -> str:
    rows = f"SELECT *, {UNIT_SCORE} AS score, bool_or(NOT low) OVER {PART} AS any_good FROM ({unit_pairs(segments)}) WHERE w >= 1.5"
    return ranked(f"SELECT * FROM ({rows}) WHERE NOT any_good OR NOT low", BEST_FIRST, 5)


def borrowed_units(segments: str) -> str:
    return ranked(f"SELECT *, 12 * w + 120.0 - away + 5 AS score FROM ({unit_pairs(segments)}) WHERE NOT low AND away <= 120 AND w >= 0.75", BEST_FIRST, 2)


def frame_matches(segments: str) -> str:
    pairs = f"""SELECT s.stream_id, segment_number, s.segment_id, event_id, ts, abs(ts - centre) AS away, {shared("t", "ft")} AS w, CASE WHEN ts >= "start" - 5 AND ts <= "end" + 5 THEN 2.0 WHEN ts >= "start" - 30 AND ts <= "end" + 30 THEN 1.0 ELSE 0.0 END::DOUBLE AS time_score FROM ({segments}) s JOIN (SELECT *, {tokens("ocr_text")} AS ft FROM ({PAGE_FRAMES})) f USING (stream_id)"""
    return ranked(f"SELECT *, 10 * w AS text_score, 10 * w + time_score AS score FROM (SELECT *, bool_or(w > 0) OVER {PART} AS hits FROM ({pairs}) WHERE w > 0 OR time_score > 0) WHERE NOT hits OR w > 0", "score DESC, away, event_id", 5)


def slide_scores(segments: str) -> str:
    pairs = f"""SELECT stream_id, segment_number, segment_id, slide_index, {shared("t", "tt")} AS title_w, {shared("t", "bt")} AS body_w, trim(title) <> '' AND contains(bundle, trim(title)) AS exact FROM ({segments}) s JOIN (SELECT deck, slide_index, title, {tokens("title")} AS tt, {tokens("text")} AS bt FROM ({SLIDES}) WHERE NOT low) USING (deck)"""
    return ranked(f"SELECT *, 20 * title_w + 6 * body_w + CASE WHEN title_w > 0 AND body_w > 0 THEN 4.0 ELSE 0.0 END + CASE WHEN exact THEN 18.0 ELSE 0.0 END AS score FROM ({pairs}) WHERE title_w > 0 OR body_w > 0 OR exact", "score DESC, slide_index", 8)


def step(d: str) -> str:
    return f"CASE WHEN {d} < -1 THEN -34.0 - 3.0 * abs({d}) WHEN {d} = -1 THEN -12.0 WHEN {d} = 0 THEN 4.0 WHEN {d} = 1 THEN 10.0 WHEN {d} <= 3 THEN 7.0 - ({d} - 1) WHEN {d} <= 8 THEN 1.5 - 0.5 * ({d} - 4) ELSE -4.0 - 1.5 * ({d} - 8) END::DOUBLE"


def step_name(d: str) -> str:
    return f"CASE WHEN {d} < -1 THEN 'sequence_backtrack_penalty' WHEN {d} = -1 THEN 'sequence_step_back_penalty' WHEN {d} = 0 THEN 'sequence_hold_bonus' WHEN {d} = 1 THEN 'sequence_advance_bonus' WHEN {d} <= 3 THEN 'sequence_nearby_bonus' WHEN {d} <= 8 THEN 'sequence_far_forward' ELSE 'sequence_large_jump_penalty' END"


def slide_path(segments: str) -> str:
    """Forward, backward and selecting recursions over the rows of candidates; bp: the place of the best predecessor."""
    opened = "(-0.6 * greatest(x.i - 1, 0) + CASE WHEN x.s >= 45 AND x.i <= 3 THEN 3.0 ELSE 0.0 END)::DOUBLE"
    totals = f"list_transform(range(1, len(p.c) + 1), lambda j: p.tot[j] + x.s + {step('(x.i - p.c[j].i)')})"
    after = f"list_transform(r.c, lambda x: list_max(list_transform(range(1, len(n.c) + 1), lambda j: {step('(n.c[j].i - x.i)')} + n.c[j].s + n.rest[j])))"
    return f"""WITH RECURSIVE sc AS MATERIALIZED ({slide_scores(segments)}),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY segment_number) AS k, count(*) OVER (PARTITION BY stream_id) AS m FROM (SELECT stream_id, segment_number, segment_id, list({{'i': slide_index, 's': score::DOUBLE}} ORDER BY "rank") AS c FROM sc GROUP BY ALL)),
f AS (SELECT stream_id, k, c, list_transform(c, lambda x: x.s + {opened}) AS tot, list_transform(c, lambda x: 0) AS bp FROM r WHERE k = 1
  UNION ALL SELECT r.stream_id, r.k, r.c, list_transform(r.c, lambda x: list_max({totals})), list_transform(r.c, lambda x: list_position({totals}, list_max({totals}))::INT) FROM f p JOIN r ON r.stream_id = p.stream_id AND r.k = p.k + 1),
b AS (SELECT stream_id, k, c, list_transform(c, lambda x: 0.0::DOUBLE) AS rest FROM r WHERE k = m
  UNION ALL SELECT r.stream_id, r.k, r.c, {after} FROM b n JOIN r ON r.stream_id = n.stream_id AND r.k = n.k - 1),
z AS (SELECT f.stream_id, f.k, f.bp, list_sort(list_transform(range(1, len(f.c) + 1), lambda j: {{'a': -f.tot[j], 'b': f.c[j].i, 'j': j}}))[1].j AS pick FROM f JOIN r USING (stream_id, k) WHERE k = m
  UNION ALL SELECT f.stream_id, f.k, f.bp, z.bp[z.pick] FROM z JOIN f ON f.stream_id = z.stream_id AND f.k = z.k - 1),
w AS (SELECT r.stream_id, r.segment_number, r.segment_id, r.k, unnest(range(1, len(r.c) + 1)) AS j, r.c, f.tot, f.bp, b.rest, z.pick, q.c AS before FROM r JOIN f USING (stream_id, k) JOIN b USING (stream_id, k) JOIN z USING (stream_id, k) LEFT JOIN r q ON q.stream_id = r.stream_id AND q.k = r.k - 1)
SELECT stream_id, segment_number, segment_id, i AS slide_index, s AS score, round(CASE WHEN k = 1 THEN {opened.replace('x.', '')} ELSE {step('(i - prev)')} END, 6) AS step_score, round(tot[j], 6) AS cumulative_score, round(tot[j] + rest[j], 6) AS global_score, prev AS previous_slide,
  CASE WHEN k > 1 THEN {step_name('(i - prev)')} WHEN s >= 45 AND i <= 3 THEN 'opening_band_earliest_preference' ELSE 'opening_sequence_preference' END AS step_reason, j = pick AS selected, round((tot[pick] + rest[pick]) - (tot[j] + rest[j]), 6) AS gap, CASE WHEN j = pick THEN '' ELSE 'lost_to_slide_' || lpad(c[pick].i::VARCHAR, 3, '0') || '_on_global_path_score' END AS reason
FROM (SELECT *, c[j].i AS i, c[j].s AS s, before[bp[j]].i AS prev FROM w)"""


def listed(rows: str, name: str, ident: str, order: str) -> str:
    return f"SELECT stream_id, segment_number, string_agg(printf('%s:%.3f', {ident}, score::DOUBLE), ',' ORDER BY {order}) AS {name} FROM ({rows}) GROUP BY ALL"


FRAME_ID = "'frame_' || event_id"
SLIDE_ID = "'slide_' || lpad(slide_index::VARCHAR, 3, '0')"
FIVE = '"rank" <= 5'
#: The mode ladder; every step looks at the segments that the steps before left.
LADDER = f"""WITH s AS MATERIALIZED ({SCORED}), led AS (SELECT * FROM s WHERE source_mode = 'slides-first'),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id, segment_number ORDER BY NOT selected, score DESC, slide_index) AS "rank" FROM ({slide_path("SELECT * FROM led")})),
rest AS MATERIALIZED (SELECT * FROM s WHERE (stream_id, segment_number) NOT IN (SELECT (stream_id, segment_number) FROM p)),
n AS MATERIALIZED ({near_units("SELECT * FROM rest")}),
g AS MATERIALIZED ({global_units("SELECT * FROM rest WHERE (stream_id, segment_number) NOT IN (SELECT (stream_id, segment_number) FROM n)")}),
u AS MATERIALIZED (SELECT stream_id, segment_number, unit_id, low, score, "rank", 'visual_unit_nearby' AS m FROM n UNION ALL SELECT stream_id, segment_number, unit_id, low, score, "rank", 'visual_unit_global' FROM g),
l AS MATERIALIZED ({borrowed_units('SELECT * FROM rest WHERE (stream_id, segment_number) IN (SELECT (stream_id, segment_number) FROM u WHERE "rank" = 1 AND low)')}),
f AS MATERIALIZED ({frame_matches("SELECT * FROM rest WHERE (stream_id, segment_number) NOT IN (SELECT (stream_id, segment_number) FROM u)")}),
one AS (SELECT s.*, pl, ul, ll, fl, u.m, u.low, u.score AS u_score, u.unit_id AS u_id, coalesce(ul IS NOT NULL AND NOT u.low, false) AS good FROM s LEFT JOIN ({listed(f"SELECT * FROM p WHERE {FIVE}", "pl", SLIDE_ID, '"rank"')}) USING (stream_id, segment_number) LEFT JOIN ({listed(f"SELECT * FROM u WHERE {FIVE}", "ul", "unit_id", '"rank"')}) USING (stream_id, segment_number)
  LEFT JOIN ({listed("SELECT * FROM l", "ll", "unit_id", '"rank"')}) USING (stream_id, segment_number) LEFT JOIN ({listed("SELECT * FROM f", "fl", FRAME_ID, '"rank"')}) USING (stream_id, segment_number) LEFT JOIN (SELECT * FROM u WHERE "rank" = 1) u USING (stream_id, segment_number)),
modes AS (SELECT *, CASE WHEN pl IS NOT NULL THEN 'ppt_slide_match' WHEN good THEN m WHEN ll IS NOT NULL THEN 'borrowed_nearby_visual' WHEN ul IS NOT NULL THEN 'suppressed_low_value' WHEN fl IS NOT NULL THEN 'frame_fallback' ELSE 'none' END AS mode FROM one)
SELECT *, {hms('trunc("start")::BIGINT')} || '-' || {hms('trunc("end")::BIGINT')} AS label, CASE mode WHEN 'ppt_slide_match' THEN string_split(pl, ',')[1] WHEN 'borrowed_nearby_visual' THEN ll WHEN 'frame_fallback' THEN string_split(fl, ',')[1] WHEN 'suppressed_low_value' THEN '' WHEN 'none' THEN '' ELSE string_split(ul, ',')[1] END AS selected_visuals, coalesce(pl, ul, fl, '') AS candidate_visuals,
CASE mode WHEN 'borrowed_nearby_visual' THEN 'borrowed nearby non-low-value visual units that also met minimum semantic overlap' WHEN 'frame_fallback' THEN 'no visual-unit match, fell back to raw frames' ELSE '' END AS borrow_reason, CASE mode WHEN 'suppressed_low_value' THEN 'nearby matched visual units were all low-value and no nearby high-quality visual met semantic overlap' WHEN 'none' THEN 'no visual candidate passed alignment thresholds' ELSE '' END AS reject_reason FROM modes"""
ALIGNMENT = f"""SELECT stream_id, segment_id, label, "start", "end", mode, selected_visuals, candidate_visuals, borrow_reason, reject_reason, source_mode FROM ({LADDER})"""
CLAUSE = "[。；：]|，(?:并|以及|随后|接着|然后|同时|并且|用|说明|解释|强调|指出|结合|通过|举|补充)"


def heading(text: str) -> str:
    """Lecture talk goes from the front, in three steps."""
    for pattern in ("^(?:本段|本节|这一段|该段|这里|接下来|随后|最后)(?:主要|重点|先|继续)?", "^(?:(?:主要|重点|先|继续)?(?:讲解|介绍|说明|讨论|围绕|展开|分析|讲))(?:了|的是)?", "^[了把将关于对从与和：:，,。 ]+"):
        text = f"regexp_replace({squeeze(text) if pattern.startswith('^(?:本') else text}, '{pattern}', '')"
    return f"trim({text})"


def capitals(text: str) -> str:
    """Whole words of 2 to 12 Latin letters with a capital, in capitals: words are runs of letters, marks, digits and underscores."""
    return f"array_to_string(list_transform(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+|[^\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda w: CASE WHEN regexp_full_match(w, '[a-zA-Z]{{2,12}}') AND lower(w) <> w THEN upper(w) ELSE w END), '')"


def stripped(text: str) -> str:
    return f"regexp_replace({text}, '^[ ，、：:;；\\-_.]+|[ ，、：:;；\\-_.]+$', '', 'g')"


def first_of(*texts: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({t}, '')" for t in texts) + ", '')"


def slide_title(text: str) -> str:
    n = f"regexp_replace({squeeze(text)}, '^[-_.:：]+|[-_.:：]+$', '', 'g')"
    return f"list_transform([{n}], lambda n: CASE WHEN length(n) < 4 OR lower(n) IN ('title', 'agenda', 'contents') OR regexp_full_match(lower(n), 'slide\\s+\\d+') OR regexp_full_match(n, '第?\\d+页') THEN '' ELSE n END)[1]"


def titled(rows: str, slide: str, into: str) -> str:
    """rows with a section's title, from (summary, body, n) and a slide's title; step by step."""
    one = f"SELECT *, {first_of(squeeze('summary'), 'body')} AS src, {sentences('body')}[1] AS sent FROM ({rows})"
    two = f"SELECT *, regexp_replace(trim(string_split_regex({heading('src')}, '{CLAUSE}')[1]), '^[ -]+|[ -]+$', '', 'g') AS c0 FROM ({one})"
    three = f"SELECT *, CASE WHEN length(c0) < 6 AND sent IS NOT NULL THEN {heading('sent')} ELSE c0 END AS c1 FROM ({two})"
    four = f"SELECT *, regexp_replace(CASE WHEN length(c1) > 30 THEN regexp_replace(substr(c1, 1, 30), '[与和的里中]+$', '') ELSE c1 END, '[ ，、]+$', '') AS c2 FROM ({three})"
    five = f"SELECT *, {first_of(slide_title(slide), 'c2', chr(39) + '课程小节 ' + chr(39) + ' || n')} AS given FROM ({four})"
    six = f"SELECT *, {stripped(capitals(squeeze('given')))} AS own, {stripped(capitals(heading('src')))} AS said FROM ({five})"
    placeholder = "regexp_full_match(lower(own), '(?:slide|part|section|chapter|page)\\s*[a-z0-9_-]*') OR regexp_full_match(lower(own), '(?:part|section)\\s*[ivx0-9]+')"
    seven = f"""SELECT *, {first_of(f"CASE WHEN NOT ({placeholder}) THEN own END", stripped(f"string_split_regex(said, '{CLAUSE}')[1]"), f"trim({capitals(first_of(squeeze('given'), squeeze('src')))})", "'课程小节'")} AS {into} FROM ({six})"""
    return f"SELECT * EXCLUDE (src, sent, c0, c1, c2, given, own, said) FROM ({seven})"


#: Selected visuals with their texts: the title of a slide, and what a formula may stand in.
SHOWN = f"""SELECT *, coalesce(page.title, '') AS slide, CASE WHEN mode = 'ppt_slide_match' THEN [page.text] WHEN mode = 'frame_fallback' THEN [frames[substr(split_part(selected_visuals, ':', 1), 7)]] WHEN selected_visuals = '' THEN []::VARCHAR[] ELSE list_transform(string_split(selected_visuals, ','), lambda x: units[stream_id || '/' || split_part(x, ':', 1)]) END AS shown, row_number() OVER (PARTITION BY stream_id ORDER BY segment_number)::INT AS n FROM (
SELECT *, (SELECT map_from_entries(list((deck || '/slide_' || lpad(slide_index::VARCHAR, 3, '0'), {{'title': title, 'text': text}}))) FROM ({SLIDES}))[deck || '/' || split_part(selected_visuals, ':', 1)] AS page, (SELECT map_from_entries(list((event_id::VARCHAR, trim(ocr_text)))) FROM ({PAGE_FRAMES})) AS frames, (SELECT map_from_entries(list((stream_id || '/' || unit_id, ocr_text))) FROM ({UNITS})) AS units FROM ({LADDER}))"""
#: Titles in order: one equal to the one before gives way to the other, or is marked.
OUTLINE = f"""WITH RECURSIVE base AS MATERIALIZED ({SHOWN}), first_title AS MATERIALIZED ({titled("SELECT * FROM base", 'slide', 'title1')}), t AS MATERIALIZED ({titled("SELECT * FROM first_title", "''", 'title2')}),
o AS (SELECT *, title1 AS title FROM t WHERE n = 1 UNION ALL SELECT t.*, CASE WHEN t.title1 <> o.title THEN t.title1 WHEN t.title2 <> '' AND t.title2 <> o.title THEN t.title2 ELSE t.title1 || '（续）' END FROM o JOIN t ON t.stream_id = o.stream_id AND t.n = o.n + 1)
SELECT *, {hms('trunc("start")::BIGINT')} AS time_label, min("start") OVER (PARTITION BY stream_id) AS chapter_start, arg_max("end", n) OVER (PARTITION BY stream_id) AS chapter_end FROM o"""


def unique(points: str, limit: int) -> str:
    """In order, points that neither hold nor are held by one kept before, white space aside."""
    bare = lambda x: f"regexp_replace({x}, '[\\s\\p{{Z}}]+', '', 'g')"
    held = f"len(list_filter(k, lambda y: contains({bare('y')}, {bare('x[1]')}) OR contains({bare('x[1]')}, {bare('y')}))) > 0"
    return f"list_reduce(list_concat([[]::VARCHAR[]], list_transform(list_filter(list_transform({points}, lambda z: {point('z')}), lambda z: z <> ''), lambda z: [z])), lambda k, x: CASE WHEN len(k) >= {limit} OR {held} THEN k ELSE list_concat(k, x) END)"


def reader(points: str, limit: int) -> str:
    return unique(f"list_filter(list_transform({points}, lambda x: {point('x')}), lambda x: length(x) >= 8 AND NOT regexp_matches(lower(x), '修正|误听|误识别|ocr|证据不足|不补写公式|未编造公式|raw -> cleaned|统一为|理顺句子|同音误识别|口误'))", limit)


def unlabelled(x: str) -> str:
    wide, plain = "^\\s*[^：]{1,8}：\\s*(\\S.*)$", "^\\s*[^:]{1,8}:\\s*(\\S.*)$"
    return f"CASE WHEN regexp_matches({x}, '(?s){wide}') THEN trim(regexp_extract({x}, '{wide}', 1)) WHEN regexp_matches({x}, '(?s){plain}') THEN trim(regexp_extract({x}, '{plain}', 1)) ELSE {x} END"


def formulas(texts: str) -> str:
    fragment = "([A-Za-z][A-Za-z0-9_(){}\\[\\]]*\\s*=\\s*[^，。；;\\n]+)"
    chunks = f"list_transform(flatten(list_transform({texts}, lambda x: string_split_regex(x, '[；;\\n]+'))), lambda x: {squeeze('x')})"
    found = f"list_transform({chunks}, lambda x: CASE WHEN regexp_matches(x, '{fragment}') THEN trim(regexp_extract(x, '{fragment}', 1)) ELSE x END)"
    good = "x <> '' AND (regexp_matches(x, '\\\\frac|\\\\sum|\\\\log') OR (length(regexp_replace(x, '[^=+\\-*/^_()\\[\\]{}<>∑Σ√≤≥≈]', '', 'g')) >= 2 AND length(regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g')) >= 3))"
    return f"list_transform([list_filter({found}, lambda x: {good})], lambda k: list_filter(k, lambda x, i: list_position(k, x) = i)[1:3])[1]"


BLOCKS = f"""SELECT *, CASE WHEN len(formulas) > 0 THEN '高' WHEN len(key_points) >= 4 OR length(trim(concat_ws(' ', summary, array_to_string(key_points, ' ')))) >= 120 THEN '中' ELSE '低' END AS difficulty, CASE WHEN len(formulas) > 0 THEN 'formula' WHEN selected_visuals <> '' THEN 'illustrated' ELSE 'summary' END AS kind FROM (
SELECT *, {unique(f"list_transform(list_concat(definitions, key_points), lambda q: {unlabelled('q')})", 5)} AS fact_points FROM (
SELECT *, {unique(f"list_concat({sentences('head')}[1:2], explained)", 5)} AS key_points, {formulas("list_concat([summary], explained, shown)")} AS formulas FROM (
SELECT *, CASE WHEN len(spoken) = 0 AND summary <> '' THEN {reader('[summary]', 2)} ELSE spoken END AS explained, CASE WHEN head <> '' THEN {reader('[head]', 2)} ELSE []::VARCHAR[] END AS definitions FROM (
SELECT *, {reader(f"{sentences('body')}[1:6]", 6)} AS spoken, {heading('summary')} AS head FROM ({OUTLINE})))))"""
STAMP = """CASE WHEN "start" >= 3600 THEN '[' || time_label || ']' ELSE '[' || lpad((trunc("start")::BIGINT // 60)::VARCHAR, 2, '0') || ':' || lpad((trunc("start")::BIGINT % 60)::VARCHAR, 2, '0') || ']' END"""
#: Corrections: a comma gone, with a reason in two of three segments; one needs three for 200 characters.
MERGED = f"""SELECT stream_id, string_agg(text, chr(10) ORDER BY segment_number) AS raw, coalesce(string_agg(cleaned, chr(10) ORDER BY segment_number) FILTER (cleaned <> ''), '') AS cleaned, count(*) AS planned, count(*) FILTER (done) AS reviewed, coalesce(string_agg(segment_id, ',' ORDER BY segment_number) FILTER (NOT done), '') AS missing, count(*) FILTER (contains(text, ',') AND segment_number % 3 <> 0 AND trim(replace(text, ',', '')) <> '') AS n_valid, sum(segment_number % 2 + 1)::BIGINT AS attempt_count FROM (SELECT *, status = 'done' AND trim(summary) <> '' AS done FROM ({REVIEWED})) GROUP BY stream_id"""
_NAMES = ["audio_path", "transcript_txt", "transcript_json", "transcript_srt", "transcript_vtt", "transcript_tsv", "visual_candidates_ocr_json", "transcript_cleaned_txt", "transcript_corrections_json", "codex_review_prompt_md", "review_segments_json", "review_report_json", "note_path", "note_generation_report_json"]


def there(*names: str) -> str:
    """Whether the query's files are there: one in seventeen is not."""
    return "(" + " AND ".join(f"(n + {_NAMES.index(x)}) % 17 <> 0" for x in names) + ")"


#: Conversations last 20 s a turn; the grid of 60 s gives at most 4 frames, one more in the middle if there is room.
READY = f"""SELECT stream_id, unnest(['audio', 'transcribe', 'frames', 'ocr', 'review_artifacts', 'codex_review', 'note', 'metadata']) AS stage, unnest([{there("audio_path")}, {there(*_NAMES[1:6])} AND n % 7 <> 0, CASE WHEN n % 13 = 0 THEN 1 ELSE 4 END >= expected, {there("visual_candidates_ocr_json")} AND n % 19 <> 0, {there(*_NAMES[7:11])} AND n % 23 <> 0, {there(*_NAMES[7:12])} AND n % 23 <> 0 AND n % 3 <> 2, {there("note_path", "note_generation_report_json")} AND n % 3 <> 0, false]) AS ready FROM (
SELECT *, stream_id AS n, grid + CASE WHEN grid > 1 AND grid < 4 AND (mid % 60 <> 0 OR mid // 60 >= grid) THEN 1 ELSE 0 END AS expected FROM (SELECT stream_id, least(4, ceil(duration / 60))::BIGINT AS grid, floor(duration / 2)::BIGINT AS mid FROM (SELECT conv_id AS stream_id, max(turn) * 20 + 20 AS duration FROM conversations GROUP BY ALL)))"""
FRAGMENT = "([A-Za-z][A-Za-z0-9_(){}\\[\\]]*\\s*=\\s*[^，。；;\\n]+)"
STAGES = "['audio', 'transcribe', 'frames', 'ocr', 'review_artifacts', 'codex_review', 'note', 'metadata']"

SQL: dict[str, str] = {
    "keyword_tokens": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_filter(t, lambda x: x NOT IN ('transformer', 'bert')))::BIGINT AS n_informative, md5(array_to_string(list_sort(t), ' ')) AS tokens_md5 FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)",
    "text_quality": f"SELECT doc_id, quality, quality < 25 AS is_low_value FROM ({QUALITY})",
    "weighted_overlap_top1": f"""WITH d AS (SELECT doc_id, unnest({tokens('text')}) AS token FROM documents), i AS (SELECT item_id, unnest({tokens('text')}) AS token FROM benchmark),
f AS (SELECT doc_id, item_id, count(*) AS raw_overlap, sum(({WEIGHT.format('token')})::DOUBLE) AS weight FROM d JOIN i USING (token) GROUP BY ALL)
SELECT doc_id, item_id, raw_overlap, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, item_id) AS r FROM f) WHERE r = 1""",
    "adjacent_jaccard": f"SELECT doc_id, source, round({jaccard('b', 't')}, 9) AS similarity FROM (SELECT *, lag(t) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM (SELECT doc_id, source, {tokens('text')} AS t FROM documents))",
    "time_labels": f"SELECT event_id, {hms('s')} AS label, CASE WHEN s >= 3600 THEN '[' || {hms('s')} || ']' ELSE '[' || lpad((s // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') || ']' END AS stamp FROM (SELECT event_id, trunc(greatest(ts * 60, 0.0))::BIGINT AS s FROM ({FRAMES}))",
    "slugs": "SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(regexp_replace(url, '\\?.*$', ''), '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1')), '[^0-9a-z\\x{4e00}-\\x{9fff}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'video') AS slug FROM pages",
    "transcript_normalize": UTTER,
    "schema_migration": "SELECT event_id, coalesce(json_extract_string(props, '$.page'), '') AS page, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.status'), 'pending') AS status FROM events",
    "bucket_argmax": f"""WITH u AS ({UTTER}), d AS (SELECT stream_id, max("end") AS duration FROM u GROUP BY ALL),
b AS (SELECT stream_id, mid, least(floor(mid / (duration / 4)), 3)::INT AS bucket, length(text) AS n, "index" FROM (SELECT u.*, duration, ("start" + "end") / 2 AS mid FROM u JOIN d USING (stream_id))),
p AS (SELECT stream_id, bucket, mid FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, bucket ORDER BY n DESC, "index") AS r FROM b) WHERE r = 1)
SELECT g.stream_id, g.bucket, round_even(coalesce(mid, g.bucket * (duration / 4)), 0)::BIGINT AS at FROM (SELECT d.*, unnest(range(4))::INT AS bucket FROM d) g LEFT JOIN p USING (stream_id, bucket)""",
    "supplement_points": f"WITH w AS ({WEAK}) SELECT DISTINCT stream_id, p AS \"at\" FROM (SELECT stream_id, unnest([greatest(0, \"at\" - 12), least(floor(duration)::BIGINT - 1, \"at\" + 12)])::BIGINT AS p FROM w WHERE weak) x WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.stream_id = x.stream_id AND w.\"at\" = x.p)",
    "upsert_union": f"WITH w AS ({WEAK}), e AS (SELECT DISTINCT stream_id, \"at\" + 1 AS p FROM w WHERE weak) SELECT coalesce(e.stream_id, w.stream_id) AS stream_id, coalesce(e.p, w.\"at\") AS \"at\", CASE WHEN e.p IS NULL THEN 'scan' ELSE 'extra' END AS origin FROM w FULL JOIN e ON w.stream_id = e.stream_id AND w.\"at\" = e.p",
    "source_mode": "SELECT s.stream_id, CASE WHEN stream_id % 3 <> 2 AND coalesce(n, 0) > 0 AND stream_id % 2 = 0 THEN 'slides-first' ELSE 'video-first' END AS mode FROM (SELECT DISTINCT conv_id AS stream_id FROM conversations) s LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY ALL) d ON d.source = 'src' || (s.stream_id % 25)",
    "learning_sentences": f"""SELECT doc_id, pos::INT AS pos, CASE WHEN regexp_matches(n, '(?s)^\\s*[^：]{{1,8}}：\\s*(\\S.*)$') THEN trim(regexp_extract(n, '^\\s*[^：]{{1,8}}：\\s*(\\S.*)$', 1)) WHEN regexp_matches(n, '^\\s*[^:]{{1,8}}:\\s*(\\S.*)$') THEN trim(regexp_extract(n, '^\\s*[^:]{{1,8}}:\\s*(\\S.*)$', 1)) ELSE n END AS sentence, regexp_matches(lower(s), '修正|误听|误识别|ocr|证据不足|不补写公式|未编造公式|raw -> cleaned|统一为|理顺句子|同音误识别|口误') AS about_process
FROM (SELECT doc_id, pos, s, regexp_replace(s, '^[ ,，、]+|[ ,，、]+$', '', 'g') AS n FROM (SELECT doc_id, unnest(range(least(4, len(s)))) AS pos, unnest(s[1:4]) AS s FROM ({SENTENCES})))""",
    "valid_corrections": "SELECT item_id, trim(text) <> '' AND trim(replace(text, ',', '')) <> '' AND item_id % 7 <> 0 AND item_id % 5 <> 0 AS valid, (CASE WHEN length(trim(text)) >= 200 THEN 3 ELSE 1 END)::BIGINT AS required FROM benchmark",
    "merge_in_order": "SELECT k, string_agg(v, chr(10) ORDER BY n) AS merged FROM (SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag AS v, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_returnflag DESC) AS r FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) WHERE r = 1 GROUP BY k",
    "sanitize_titles": f"""SELECT page_id, clean, noisy, CASE WHEN length(n) < 4 OR lower(n) IN ('title', 'agenda', 'contents') OR regexp_matches(lower(n), '^slide\\s+\\d+$') OR regexp_matches(n, '^第?\\d+页$') THEN '' ELSE n END AS title FROM (
SELECT *, regexp_replace({squeeze("clean")}, '^[-_.:：]+|[-_.:：]+$', '', 'g') AS n FROM (SELECT page_id, {slide_text("t")} AS clean, {noise("t")} AS noisy FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)))""",
    "formula_candidates": f"""SELECT doc_id, 'expression_' || pos AS name, latex FROM (SELECT doc_id, unnest(range(1, least(3, len(l)) + 1)) AS pos, unnest(l[1:3]) AS latex FROM (SELECT doc_id, list_filter(k, lambda x, i: list_position(k, x) = i) AS l FROM (
SELECT doc_id, list_filter(list_transform(c, lambda x: CASE WHEN regexp_matches(x, '{FRAGMENT}') THEN trim(regexp_extract(x, '{FRAGMENT}', 1)) ELSE x END), lambda x: x <> '' AND (regexp_matches(x, '\\\\frac|\\\\sum|\\\\log') OR (length(regexp_replace(x, '[^=+\\-*/^_()\\[\\]{{}}<>∑Σ√≤≥≈]', '', 'g')) >= 2 AND length(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 3))) AS k
FROM (SELECT doc_id, list_transform(string_split_regex(coalesce(text, ''), '[；;\\n]+'), lambda x: {squeeze("x")}) AS c FROM documents))))""",
    "missing_reviews": f"SELECT doc_id AS segment_id, source FROM documents WHERE doc_id NOT IN ({DONE})",
    "change_kinds": f"SELECT stream_id, event_id, stable, change_kind, reason, round(similarity, 9) AS similarity FROM ({kinds(FRAMES)})",
    "page_clusters": rollup(clusters(FRAMES)),
    "representatives": f"SELECT stream_id, cluster, event_id, score FROM ({best_frames(clusters(FRAMES))})",
    "visual_units": f"""SELECT stream_id, unit_id, "start", "end", frame_count, frames, event_id, ocr_len, quality, change_kind, candidate, low FROM ({visual_units(FRAMES)})""",
    "change_points": f"""WITH f AS ({FRAMES}), d AS (SELECT *, max(ts) OVER (PARTITION BY stream_id) AS duration, row_number() OVER w AS n, lag(ts) OVER w AS before FROM f WINDOW w AS {BY_TIME}),
q AS (SELECT *, NOT coalesce(bool_or(n > 1 AND change_ratio >= 0.02) OVER (PARTITION BY stream_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), false) AS stable FROM d),
c AS (SELECT stream_id, duration, before AS t, scene_score + change_ratio * 100 + component_ratio * 50 AS s FROM q WHERE n > 1 AND stable AND duration > 0 AND (change_ratio >= 0.12 OR (change_ratio >= 0.08 AND component_ratio >= 0.02)) UNION ALL SELECT DISTINCT stream_id, duration, unnest([0.0, greatest(0.0, duration - 1.0)]), 0.0 FROM d WHERE duration > 0),
o AS (SELECT stream_id, greatest(0, least(round_even(t, 0)::BIGINT, trunc(duration)::BIGINT)) AS a, max(s) AS s FROM c GROUP BY ALL)
SELECT stream_id, p.a AS "at", p.s AS strength FROM (SELECT stream_id, p, row_number() OVER (PARTITION BY stream_id ORDER BY p.s DESC, p.a) AS r FROM (SELECT stream_id, unnest(kept) AS p FROM (
SELECT stream_id, list_reduce(list_transform(l, lambda x: [x]), lambda k, x: CASE WHEN x[1].a - k[-1].a >= 8 THEN list_concat(k, x) WHEN x[1].s >= k[-1].s THEN list_concat(k[:-2], x) ELSE k END) AS kept FROM (SELECT stream_id, list({{'a': a, 's': s}} ORDER BY a) AS l FROM o GROUP BY stream_id)))) WHERE r <= 18""",
    "review_segments": f"SELECT *, length(text) AS char_count FROM ({SEGMENTS})",
    "segment_hints": f"SELECT stream_id, segment_id, array_to_string(hints, chr(10)) AS hints FROM ({HINTS})",
    "slide_pages": f"SELECT deck, slide_index, title, low, md5(text) AS text_md5 FROM ({RAW_SLIDES})",
    "slide_pages_clean": f"SELECT deck, slide_index, title, low, md5(text) AS text_md5 FROM ({SLIDES})",
    "near_matches": f"""SELECT stream_id, segment_number, segment_id, unit_id, low, w, away, round(score, 6) AS score, "rank" FROM ({near_units(SCORED)})""",
    "global_matches": f"""SELECT stream_id, segment_number, segment_id, unit_id, low, w, away, round(score, 6) AS score, "rank" FROM ({global_units(SCORED)})""",
    "borrowed_matches": f"""SELECT stream_id, segment_number, segment_id, unit_id, w, away, round(score, 6) AS score, "rank" FROM ({borrowed_units(SCORED)})""",
    "frame_fallback": f"""SELECT stream_id, segment_number, segment_id, event_id, ts, text_score, time_score, score, "rank" FROM ({frame_matches(SCORED)})""",
    "slide_scores": f"""SELECT stream_id, segment_number, segment_id, slide_index, title_w, body_w, exact, score, "rank" FROM ({slide_scores(SCORED)})""",
    "slide_path": slide_path(SCORED),
    "alignment": f"SELECT * EXCLUDE (source_mode) FROM ({ALIGNMENT})",
    "alignment_summary": f"""SELECT stream_id, count(*) AS segment_count, count(*) FILTER (selected_visuals <> '') AS segments_with_visuals, max(source_mode) AS visual_source_mode, (SELECT count(*) FROM ({RAW_SLIDES}) d WHERE d.deck = a.stream_id % 20) AS ppt_slide_count, (SELECT count(*) FROM ({UNITS}) u WHERE u.stream_id = a.stream_id) AS visual_unit_count, (SELECT count(*) FROM documents WHERE doc_id // 10 = a.stream_id) AS frame_count FROM ({ALIGNMENT}) a GROUP BY stream_id""",
    "unique_points": f"""SELECT doc_id, coalesce(array_to_string(list_reduce(list_concat([[]::VARCHAR[]], list_transform(p, lambda x: [x])), lambda k, x: CASE WHEN len(k) >= 3 OR len(list_filter(k, lambda y: contains(regexp_replace(y, '\\s+', '', 'g'), regexp_replace(x[1], '\\s+', '', 'g')) OR contains(regexp_replace(x[1], '\\s+', '', 'g'), regexp_replace(y, '\\s+', '', 'g')))) > 0 THEN k ELSE list_concat(k, x) END), chr(10)), '') AS points FROM (
SELECT doc_id, list_filter(s[1:6], lambda x: length(x) >= 8 AND NOT regexp_matches(lower(x), '修正|误听|误识别|ocr|证据不足|不补写公式|未编造公式|raw -> cleaned|统一为|理顺句子|同音误识别|口误')) AS p FROM ({SENTENCES}))""",
    "review_merge": f"SELECT stream_id, md5(cleaned) AS cleaned_md5, missing, n_valid, planned, reviewed FROM ({MERGED})",
    "review_report": f"""SELECT stream_id, CASE WHEN reasons = '' THEN 'passed' ELSE 'failed' END AS status, attempt_count, raw <> '' AND cleaned <> '' AND raw <> cleaned AS cleaned_differs, planned, reviewed, missing, n_valid, required, reasons FROM (SELECT *, concat_ws('; ', CASE WHEN cleaned = '' THEN 'transcript.cleaned.txt 为空' WHEN cleaned = raw THEN 'transcript.cleaned.txt 与 transcript.txt 完全相同' END, CASE WHEN stream_id % 5 = 0 THEN 'review_status 不是 done' END, CASE WHEN stream_id % 11 = 0 THEN 'last_updated 为空' END, CASE WHEN missing <> '' THEN 'segment_reviews 未覆盖全部分段: ' || replace(missing, ',', ', ') END, CASE WHEN n_valid < required THEN '有效纠错条目不足 ' || required || ' 条' END) AS reasons FROM (SELECT *, CASE WHEN length(raw) >= 200 THEN 3 ELSE 1 END AS required FROM ({MERGED})))""",
    "cleanup_validation": f"""SELECT deck, count(*) FILTER (key % 97 = 0) AS lost, 0::BIGINT AS extra, count(*) FILTER (a) AS noise_before, count(*) FILTER (b AND key % 97 <> 0) AS noise_after, count(*) FILTER (key % 97 = 0) = 0 AND count(*) FILTER (b AND key % 97 <> 0) <= count(*) FILTER (a) AS ok FROM (SELECT deck, deck * 50 + slide_index AS key, {noise("r.title")} OR {noise("r.text")} AS a, {noise("c.title")} OR {noise("CASE WHEN (deck * 50 + slide_index) % 89 = 0 THEN c.text || ' ☃☃☃' ELSE c.text END")} AS b FROM ({RAW_SLIDES}) r JOIN ({SLIDES}) c USING (deck, slide_index)) GROUP BY deck""",
    "artifact_readiness": READY,
    "stage_plan": f"""WITH s AS (SELECT *, CASE WHEN stream_id % 4 = 0 THEN stage = 'note' WHEN stream_id % 9 = 0 THEN stage = 'ocr' ELSE false END AS forced, list_position({STAGES}, stage) AS n FROM ({READY})),
u AS (SELECT *, coalesce(bool_or(stage <> 'metadata' AND (forced OR NOT ready)) OVER (PARTITION BY stream_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS upset, bool_or(stage = 'note' AND forced) OVER (PARTITION BY stream_id) AND NOT bool_or(stage NOT IN ('note', 'metadata') AND forced) OVER (PARTITION BY stream_id) AS note_only FROM s)
SELECT stream_id, stage, stage = 'metadata' OR forced OR upset OR NOT ready AS run, CASE WHEN stage = 'metadata' THEN 'metadata is always refreshed' WHEN forced THEN 'forced rerun for ' || stage WHEN upset THEN 'rerun because an upstream stage is being recomputed' WHEN NOT ready THEN 'artifacts missing or incomplete' WHEN note_only THEN 'preserved for note-only rerender' ELSE 'artifacts already complete' END AS reason FROM u""",
    "outline": f"""SELECT stream_id, n AS number, 'section_' || lpad(n::VARCHAR, 3, '0') AS section_id, segment_number, segment_id, title, {first_of('trim(slide)', 'title')} AS source_title, time_label, "start", "end", chapter_start, chapter_end, {hms('trunc(chapter_start)::BIGINT')} AS chapter_label FROM ({OUTLINE})""",
    "knowledge_blocks": f"""SELECT stream_id, 'block_' || lpad(n::VARCHAR, 3, '0') AS block_id, 'section_' || lpad(n::VARCHAR, 3, '0') AS section_id, title, summary, array_to_string(explained, chr(10)) AS explanation_points, array_to_string(key_points, chr(10)) AS key_points, array_to_string(fact_points, chr(10)) AS fact_points, array_to_string(definitions, chr(10)) AS definitions, array_to_string(formulas, chr(10)) AS formulas, concat_ws(',', CASE WHEN len(definitions) > 0 THEN 'definition:' || least(2, len(definitions)) END, CASE WHEN len(fact_points) > 0 THEN 'key_points:' || least(4, len(fact_points)) END, CASE WHEN len(formulas) > 0 THEN 'formula:' || len(formulas) END) AS units, difficulty, kind, {STAMP} AS timestamp_ref, split_part(selected_visuals, ':', 1) AS visual FROM ({BLOCKS})""",
    "note_gate": f"""SELECT stream_id, concat_ws('; ', CASE WHEN stream_id % 6 = 5 THEN 'note.md 为空' WHEN stream_id % 10 = 7 THEN 'note.md 缺少知识小结' END, CASE WHEN stream_id % 6 <> 5 AND k IS NULL THEN 'note.md 缺少核心定义卡片; note.md 缺少知识框架' || CASE WHEN stream_id IN (SELECT doc_id // 10 FROM documents) THEN '' ELSE '; note.md 缺少精确时间戳引用' END END) AS reasons, stream_id % 6 <> 5 AND stream_id % 10 <> 7 AND k IS NOT NULL AS passed FROM (SELECT DISTINCT stream_id FROM ({SEGMENTS})) LEFT JOIN (SELECT stream_id, count(*) AS k FROM ({REVIEWED}) WHERE status = 'done' AND trim(summary) <> '' GROUP BY ALL) USING (stream_id)""",
    "related_frames": f"""SELECT s.stream_id, segment_number, event_id, ts FROM ({SEGMENTS}) s JOIN ({PAGE_FRAMES}) f ON f.stream_id = s.stream_id AND ts >= "start" - 5 AND ts <= "end" + 5""",
    "segment_review_reasons": f"""SELECT stream_id, segment_id, CASE WHEN segment_number % 3 = 0 THEN 'segment.cleaned.txt 不存在' ELSE concat_ws('; ', CASE WHEN cleaned = '' THEN 'segment.cleaned.txt 为空' WHEN cleaned = trim(text) THEN 'segment.cleaned.txt 与 segment_transcript.txt 完全相同' END, CASE WHEN status <> 'done' THEN 'review_status 不是 done' END, CASE WHEN segment_number % 5 = 0 THEN 'last_updated 为空' END, CASE WHEN status <> 'done' OR trim(summary) = '' THEN 'segment_reviews 未覆盖全部分段: ' || segment_id END, CASE WHEN (CASE WHEN contains(text, ',') AND trim(replace(text, ',', '')) <> '' THEN 1 ELSE 0 END) < need THEN '有效纠错条目不足 ' || need || ' 条' END) END AS reasons FROM (SELECT *, CASE WHEN length(trim(text)) >= 200 THEN 3 ELSE 1 END AS need FROM ({REVIEWED}))""",
}
