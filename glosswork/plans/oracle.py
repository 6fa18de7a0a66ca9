"""SQL (DuckDB dialect) of the registered phrase-table queries."""

from __future__ import annotations

from glosswork.plans import fixtures as fx

EDGE = r"[\t-\r \x85\p{Z}]"
WORD = r"[\p{L}\p{N}][\p{L}\p{N}'’_-]*"
MASK = "chr(57344)"


# The patterns of the import rules and of the cleanup rules, written for this dialect and not taken from the rules' module.
TECHNICAL = {
    "markup": r"(?i)</?\w+|&(?:[a-z]+|#\d+);|<!DOCTYPE|<\?xml",
    "style": r"(?i)(?:^|[\s;])(?:margin|padding|font-size|background|color|display|width|height)\s*:|\.[A-Za-z0-9_-]+\s*\{|#(?:[A-Fa-f0-9]{3}){1,2}\b",
    "url": r"(?i)(?:https?|ftp)://|www\.|\b\w+://",
    "code": r"(?i)\b(?:function|class|return|if|else|while|for|var|let|const|import|include)\b\s*[({;]|(?:->|=>|::|==|!=|<=|>=|&&|\|\|)|[{}\[\];]{2,}",
    "variable": r"%\d+|%[A-Za-z_]+|\$\{?\w+\}?|\{\d+\}|@[A-Za-z_]+@|__[A-Za-z0-9_]+__|\b[A-Z_]{3,}\b",
    "pid": r"(?i)\bPID\b|\bprocess\s+id\b",
    "auth": r"(?i)\bAuthorization\b|\bBearer\b|\bOAuth\b|\bAPI[-_ ]?Key\b|\btoken\b",
    "tooltip": r"(?i)\btooltip\b|tool\s*tip",
    "path": r"[A-Za-z]:\\|/\w+/|\.\.?/|\w+/\w+\.\w{1,6}\b",
    "email": r"(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b",
    "catalog": r"(?i)unit\s+synonyms\s+for\s+matching\s+user\s+input|amount\s+in\s+units\s*\((?:real|integer)\)",
}
STORED_JUNK = [
    r"(?i)</?\w+|&(?:[a-z]+|#\d+);|<!DOCTYPE|<\?xml",
    r"(?i)(?:^|[\s;])(?:margin|padding|font-size|background|display|width|height)\s*:|\.[A-Za-z0-9_-]+\s*\{|#(?:[A-Fa-f0-9]{3}){1,2}\b",
    r"(?i)(?:https?|ftp)://|www\.|\b\w+://",
    r"(?i)\b(?:function|class|return|while|for|var|let|const|include)\b\s*[({;]|(?:->|=>|::|==|!=|<=|>=|&&|\|\|)|[{}\[\];]{3,}",
    r"(?i)Authorization\s*:\s*(?:Bearer|Basic)|\bBearer\s+[A-Za-z0-9._\-]{16,}|\bOAuth\b|\bAPI[-_ ]?Key\s*[:=]|\btoken\s*[:=]\s*[A-Za-z0-9._\-]{12,}",
    r"(?i)\bPID\s*[:=#]?\s*\d+\b|\bprocess\s+id\s*[:=#]?\s*\d+\b",
    r"(?i)<[^>]*tooltip|tooltip\s*[:=]\s*['\"<{]",
    r"(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b",
    r"(?i)unit\s+synonyms\s+for\s+matching\s+user\s+input|amount\s+in\s+units\s*\((?:real|integer)\)",
]
NUMBERS = r"^[\d\s.,:/_\-+]+$"
LONG_TOKEN = r"\b[A-Za-z0-9_./\\-]{35,}\b"


def q(s) -> str:
    return "'" + str(s).replace("'", "''") + "'" if not isinstance(s, int) else str(s)


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def trim(x: str) -> str:
    return sub(x, f"^{EDGE}+|{EDGE}+$", "")


def ws(x: str) -> str:
    return trim(sub(x, r"[\t-\r ]+", " "))


def norm(x: str) -> str:
    x = f"translate(lower({x}), {q('‘’“”')}, {q(chr(39) * 2 + chr(34) * 2)})"
    for a, b in ((r"\bcan't\b", "cannot"), (r"\bwon't\b", "will not"), (r"\bn't\b", " not"), (r"\bi'm\b", "i am"), (r"\b(\w+)'re\b", r"\1 are"), (r"\b(\w+)'ll\b", r"\1 will"),
                 (r"\b(\w+)'ve\b", r"\1 have"), (r"\b(\w+)'d\b", r"\1 would"), (r"\b(\w+)'s\b", r"\1"), (r"[.,;:!?()\[\]{}\"']", " "), (r"(\p{L})-(\p{L})", r"\1 \2"), (r"(\p{L})-(\p{L})", r"\1 \2")):
        x = sub(x, a, b)
    return ws(x)


def words(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda w: w <> '')"


def units(x: str) -> str:
    return sub(x, r"[\x{10000}-\x{10FFFF}]", "§§")


def values(rows: list, columns: str) -> str:
    lines = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(q(c) for c in r) + ')' for r in lines)}) AS v(i, {columns}))"


def seg_list(x: str) -> str:
    return f"list_filter(regexp_split_to_array({ws(x)}, '[.!?]+[\\t-\\r ]*'), lambda s: s <> '')"


SEGMENTS = f"""segs AS (SELECT lang, doc_id, {seg_list('text')} AS l FROM documents),
segments AS (SELECT lang, doc_id, unnest(l) AS seg, unnest(range(0, len(l))) AS pos FROM segs)"""
TEXTS = f"""{SEGMENTS}, texts AS (SELECT doc_id AS id, pos, seg AS text FROM segments UNION ALL SELECT -i - 1, 0, text FROM {values(fx.TEXTS, 'text')})"""
FILTER_INPUTS = f"""lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
inputs0 AS (SELECT 'line' AS kind, doc_id AS id, unnest(range(0, len(l))) AS pos, unnest(l) AS text FROM lines
  UNION ALL SELECT 'html', page_id, 0, html FROM pages UNION ALL SELECT 'url', page_id, 0, url FROM pages
  UNION ALL SELECT 'source', i, 0, source FROM {values(fx.PAIRS, 'source, target')} UNION ALL SELECT 'target', i, 0, target FROM {values(fx.PAIRS, 'source, target')}),
inputs1 AS (SELECT kind, id, pos, {ws('text')} AS text FROM inputs0),
inputs2 AS (SELECT * FROM inputs1 UNION ALL SELECT 'lit', i, 0, source FROM {values(fx.STORED, 'source, target')})"""
PARALLEL = f"""{SEGMENTS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, pos) AS line_no FROM segments),
parallel AS (SELECT a.lang AS source_lang, b.lang AS target_lang, a.line_no, a.seg AS source_raw, b.seg AS target_raw
  FROM numbered a JOIN numbered b ON a.line_no = b.line_no AND a.lang = 'en' AND b.lang IN ('de', 'es', 'fr')),
raw_pairs AS (SELECT * FROM parallel UNION ALL SELECT target_lang, source_lang, line_no, target_raw, source_raw FROM parallel)"""


def pieces(x: str) -> str:
    return f"regexp_split_to_array(lower({x}), '[\\t-\\r ]+')"


def repeated(p: str, k: int) -> str:
    middle = " AND ".join([f"{p}[i + {j}] = {p}[i + 1]" for j in range(2, k - 1)] or ["true"])
    return f"""len(list_filter(range(1, greatest(1, len({p}) - {k - 2})), lambda i: regexp_full_match({p}[i + 1], '\\w+') AND {middle}
      AND regexp_extract({p}[i], '\\w+$') = {p}[i + 1] AND regexp_extract({p}[i + {k - 1}], '^\\w+') = {p}[i + 1])) > 0"""


def one_word_over(x: str, n: int) -> str:
    return f"(len(list_filter(regexp_split_to_array({x}, '[\\t-\\r ]+'), lambda w: w <> '')) = 1 AND length({units(x)}) > {n})"


SYMBOL = r"[^\p{L}\p{N}\t-\r \x85\p{Z}]"


def symbols(x: str, ratio: float, run: int) -> str:
    kept = sub(units(x), r"[\p{L}\p{N}\t-\r \x85\p{Z}]", "")
    return f"(NOT {has(units(x), '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')} OR CAST(length({kept}) AS DOUBLE) / greatest(length({units(x)}), 1) > {ratio} OR {has(units(x), SYMBOL + '{' + str(run) + ',}')})"


def bad_length(x: str) -> str:
    return f"(length({units(x)}) > 500 OR length({units(x)}) < 2)"


def strange(x: str, p: str) -> str:
    return f"({has(x, NUMBERS)} OR {repeated(p, 4)} OR {has(x, LONG_TOKEN)} OR {one_word_over(x, 40)})"


def control(x: str) -> str:
    return has(x, r"[\x00-\x08\x0E-\x1F\x7F-\x84\x86-\x9F]")


def stored_symbols(x: str) -> str:
    return f"({symbols(x, 0.45, 6)} OR CAST(length({sub(x, '[^' + chr(0xFFFD) + ']', '')}) AS DOUBLE) / greatest(length({units(x)}), 1) > 0.05)"


def broken(x: str, p: str) -> str:
    return f"({repeated(p, 5)} OR {has(x, NUMBERS)} OR {one_word_over(x, 80)})"


def any_of(parts) -> str:
    return "(" + " OR ".join(parts) + ")"


def junk(x: str) -> str:
    return any_of(has(x, p) for p in STORED_JUNK)


def rejected(s: str, t: str, ps: str, pt: str) -> str:
    each = [f"{x} = ''" for x in (s, t)] + [bad_length(x) for x in (s, t)] + [f"({norm(s)} <> '' AND {norm(s)} = {norm(t)})"]
    each += [has(x, p) for x in (s, t) for p in TECHNICAL.values()] + [symbols(x, 0.35, 4) for x in (s, t)] + [strange(s, ps), strange(t, pt)]
    return any_of(each)


def invalid(s: str, t: str, ps: str, pt: str) -> str:
    each = [f"{trim(x)} = ''" for x in (s, t)] + [f"({norm(s)} <> '' AND {norm(s)} = {norm(t)})"] + [f"length({units(x)}) > 800" for x in (s, t)]
    each += [f(x) for f in (control, junk, stored_symbols) for x in (s, t)] + [broken(s, ps), broken(t, pt)]
    return any_of(each)


IMPORTED = f"""{PARALLEL}, clean AS (SELECT source_lang, target_lang, line_no, {ws('source_raw')} AS s, {ws('target_raw')} AS t FROM raw_pairs),
pieced AS (SELECT *, {pieces('s')} AS ps, {pieces('t')} AS pt FROM clean), judged AS (SELECT *, {rejected('s', 't', 'ps', 'pt')} AS bad FROM pieced),
imported AS (SELECT line_no, {norm('s')} AS source_text, t AS translated_text, source_lang, target_lang FROM judged WHERE NOT bad)"""
KEY = "source_text, translated_text, source_lang, target_lang"
BUILT = f"""{IMPORTED}, counted AS (SELECT {KEY}, min(line_no) AS first_line, count(*) AS frequency FROM imported GROUP BY ALL),
built AS (SELECT row_number() OVER (ORDER BY source_lang, target_lang, first_line, source_text, translated_text) AS id, {KEY}, frequency FROM counted)"""
BEST = "row_number() OVER (PARTITION BY source_lang, target_lang, source_text ORDER BY frequency DESC, length(translated_text), id) = 1"
UNFILTERED = f"""{PARALLEL}, unfiltered AS (SELECT line_no, {norm(ws('source_raw'))} AS source_text, {ws('target_raw')} AS translated_text, source_lang, target_lang FROM raw_pairs),
counted AS (SELECT {KEY}, min(line_no) AS first_line, count(*) AS frequency FROM unfiltered GROUP BY ALL),
built AS (SELECT row_number() OVER (ORDER BY source_lang, target_lang, first_line, source_text, translated_text) AS id, {KEY}, frequency FROM counted)"""
EXISTING = f"""{IMPORTED}, fresh AS (SELECT {KEY}, min(line_no) AS first_line, count(*) AS frequency FROM imported GROUP BY ALL),
existing AS (SELECT row_number() OVER (ORDER BY source_lang, target_lang, first_line, source_text, translated_text) AS id, {KEY}, frequency FROM fresh WHERE source_lang = 'en')"""
MERGED = f"{IMPORTED}, merged AS (SELECT {KEY}, count(*) AS frequency FROM imported GROUP BY ALL)"


def canonical(x: str) -> str:
    low = f"lower(translate({trim(x)}, '-', '_'))"
    parts = f"list_filter(string_split({low}, '_'), lambda p: p <> '')"
    return f"""CASE WHEN {low} = '' THEN '' WHEN split_part({low}, '_', 1) = 'pt' OR {low} IN ('por', 'ptbr') THEN 'pt_BR' WHEN split_part({low}, '_', 1) IN ('en', 'fr', 'es') THEN split_part({low}, '_', 1)
      WHEN len({parts}) >= 2 THEN {parts}[1] || '_' || upper({parts}[2]) ELSE {low} END"""


def letters(x: str) -> str:
    return has(units(x), r"\p{L}")


def caps(x: str) -> str:
    return f"({letters(x)} AND NOT {has(units(x), chr(92) + 'p{Ll}')})"


def starts_upper(x: str) -> str:
    return has(units(x), r"^[^\p{L}]*\p{Lu}")


HEAD = r"(?s)^([^\p{L}]*)(\p{L})(.*)$"


def capital(x: str) -> str:
    first = f"regexp_extract({x}, {q(HEAD)}, 2)"
    return f"CASE WHEN {letters(x)} THEN regexp_extract({x}, {q(HEAD)}, 1) || CASE WHEN {first} = 'ß' THEN 'ß' ELSE upper({first}) END || regexp_extract({x}, {q(HEAD)}, 3) ELSE {x} END"


def marks(x: str) -> str:
    return f"string_split({sub(sub(x, WORD, chr(2)), '[^' + chr(92) + 'x02,;:]', '')}, chr(2))[2:]"


def opening(x: str) -> str:
    return sub("regexp_extract(" + x + ", " + q("^(?:[" + chr(34) + chr(40) + chr(92) + "[{" + chr(39) + "]|" + EDGE + ")*") + ")", EDGE + "+", "")


def closing(x: str) -> str:
    return sub("regexp_extract(" + x + ", " + q("(?:[" + chr(34) + ")" + chr(92) + "]}" + chr(39) + "]|" + EDGE + ")*$") + ")", EDGE + "+", "")


CAPITAL, MARKS = capital("text"), marks("text")


def text_sql(columns: str, more: str = "", source: str = "texts") -> str:
    return f"WITH {TEXTS}{more} SELECT id, pos, {columns} FROM {source}"


def candidate_sql(source: str, keys: str) -> str:
    """CTEs from ``source`` (keys, words) to cands (keys, pos, len, variant, candidate)."""
    short = "list_filter(part, lambda w: w NOT IN ('a', 'an', 'the', 'please', 'just'))"
    return f"""starts AS (SELECT {keys}, words, unnest(range(0, len(words))) AS pos FROM {source}),
sizes AS (SELECT {keys}, words, pos, unnest(range(1, least(12, len(words) - pos) + 1)) AS len FROM starts),
parts AS (SELECT {keys}, pos, len, words[pos + 1:pos + len] AS part FROM sizes),
shorts AS (SELECT *, {short} AS short FROM parts),
cands AS (SELECT {keys}, CAST(pos AS INTEGER) AS pos, CAST(len AS INTEGER) AS len, CAST(0 AS INTEGER) AS variant, array_to_string(part, ' ') AS candidate FROM shorts
  UNION ALL SELECT {keys}, CAST(pos AS INTEGER), CAST(len AS INTEGER), CAST(1 AS INTEGER), array_to_string(short, ' ') FROM shorts WHERE len(short) >= 2 AND len(short) < len)"""


FILES = f"""{PARALLEL}, filed AS (SELECT 'docs' || CAST((line_no - 1) // {fx.LINES_A_FILE} AS VARCHAR) AS corpus, target_lang AS target, (line_no - 1) % {fx.LINES_A_FILE} AS n, source_raw, target_raw FROM parallel),
sides AS (SELECT corpus || '.en-' || target || '.en' AS file_name, n, source_raw AS line FROM filed UNION ALL SELECT corpus || '.en-' || target || '.' || target, n, target_raw FROM filed),
f AS (SELECT file_name, CAST(sum(strlen(line) + 1) AS BIGINT) AS size, arg_min(line, n) AS first_line FROM sides GROUP BY file_name
  UNION ALL SELECT file_name, size, first_line FROM {values(fx.FILES, 'file_name, size, first_line')})"""


def listing(more: str = "") -> str:
    return f"WITH {FILES}{more}"


TOKEN = "'^[A-Za-z]{2,3}(_[A-Za-z0-9]{2,8})?$'"
PARSED = f""", d AS (SELECT *, string_split(file_name, '.') AS p FROM f),
e AS (SELECT *, p[len(p)] AS language, p[len(p) - 1] AS lang_pair, array_to_string(p[1:len(p) - 2], '.') AS corpus_name FROM d WHERE len(p) >= 3),
g AS (SELECT *, split_part(lang_pair, '-', 1) AS src, substr(lang_pair, strpos(lang_pair, '-') + 1) AS tgt FROM e WHERE strpos(lang_pair, '-') > 0),
h AS (SELECT * FROM g WHERE corpus_name <> '' AND regexp_matches(language, {TOKEN}) AND regexp_matches(src, {TOKEN}) AND regexp_matches(tgt, {TOKEN}) AND language IN (src, tgt))"""
READABLE = f"(size >= 8 AND {trim('first_line')} <> '')"
CODES = f"""c0 AS (SELECT doc_id, [lang, upper(lang), concat_ws('-', lang, upper(lang)), concat_ws('_', lang, source), ' ' || lang || '-', source, concat_ws('-', 'pt', lang)] AS l FROM documents),
codes AS (SELECT doc_id AS id, CAST(unnest(range(0, len(l))) AS INTEGER) AS n, unnest(l) AS code FROM c0 UNION ALL SELECT -i - 1, 0, code FROM {values(fx.CODES, 'code')})"""


def spelt(x: str) -> str:
    return f"CASE length(translated_text) % 3 WHEN 0 THEN upper({x}) WHEN 1 THEN {x} || '-at' ELSE {x} END"


LEGACY = f"""WITH {IMPORTED}, t AS (SELECT source_text, translated_text, {spelt('source_lang')} AS source_lang, {spelt('target_lang')} AS target_lang FROM imported
  UNION ALL SELECT {KEY} FROM {values(fx.LEGACY, KEY)})"""
SMALL = f"""bs AS (SELECT item_id AS id, {seg_list('text')} AS l FROM benchmark), bt AS (SELECT id, unnest(range(0, len(l))) AS seg, unnest(l) AS text FROM bs),
bw AS (SELECT {words('text')} AS w FROM bt), bp AS (SELECT unnest([array_to_string(w[1:1], ' '), array_to_string(w[1:2], ' '), array_to_string(w[2:4], ' ')]) AS p FROM bw),
bc AS (SELECT p, count(*) AS n FROM bp WHERE p <> '' GROUP BY p),
small AS (SELECT id, source_text, translated_text, source_lang, target_lang, frequency FROM (VALUES {', '.join('(' + ', '.join(q(c) for c in r) + ')' for r in fx.TABLE)}) AS v(id, {KEY}, frequency)
  UNION ALL SELECT 100 + row_number() OVER (ORDER BY p), p, 'x' || p, 'en', 'pt_BR', n FROM bc),
best AS (SELECT source_text AS candidate, translated_text AS translation FROM small WHERE source_lang = 'en' AND target_lang = 'pt_BR' QUALIFY {BEST})"""
SMALL_PARTS = f"(SELECT id, seg, text FROM bt UNION ALL SELECT -i - 1, 0, text FROM {values(fx.INPUTS, 'text')})"
SMALL_INPUTS = f"ins AS (SELECT id, seg, {words('text')} AS words FROM {SMALL_PARTS})"
TRACE = "row_number() OVER (PARTITION BY {keys}, pos ORDER BY len DESC, variant) = 1"
SMALL_TRACE = f"WITH {SMALL}, {SMALL_INPUTS}, {candidate_sql('ins', 'id, seg')}, trace AS (SELECT id, seg, pos, len, variant, candidate AS matched, translation FROM cands JOIN best USING (candidate) QUALIFY {TRACE.format(keys='id, seg')})"
ABBREVIATION = rf"(?i)(^|[\t-\r ])(mr|mrs|ms|dr|prof|sr|jr|etc|e\.g|i\.e|vs)({EDGE}*)\."



def sentence_sql(source: str, keys: str, text: str) -> str:
    """CTEs from ``source`` (keys, text) to sentences (keys, seg_no, text, delimiter)."""
    number = "(" + chr(92) + "p{Nd})" + chr(92) + ".(" + chr(92) + "p{Nd})"
    masked = chr(92) + "1" + chr(0xE000) + chr(92) + "2"
    parts = "regexp_extract_all(m, '(?s)([^.!?]*)([.!?][.!?\"'')\\]}]*|$)', "
    return f"""m1 AS (SELECT {keys}, {sub(sub(text, number, masked), number, masked)} AS m FROM {source}),
m2 AS (SELECT {keys}, {sub('m', ABBREVIATION, chr(92) + '1' + chr(92) + '2' + chr(92) + '3' + chr(0xE000))} AS m FROM m1),
x AS (SELECT {keys}, {parts}1) AS a, {parts}2) AS d FROM m2),
y AS (SELECT {keys}, list_filter(list_transform(range(1, len(a) + 1), lambda i: {{'text': translate({trim('a[i]')}, {MASK}, '.'), 'delimiter': translate(d[i], {MASK}, '.')}}), lambda s: s.text <> '' OR s.delimiter <> '') AS l FROM x),
z AS (SELECT {keys}, CASE WHEN len(l) = 0 THEN [{{'text': '', 'delimiter': ''}}] ELSE l END AS l FROM y),
w AS (SELECT {keys}, CAST(unnest(range(0, len(l))) AS INTEGER) AS seg_no, unnest(l) AS s FROM z),
sentences AS (SELECT {keys}, seg_no, s.text AS text, s.delimiter AS delimiter FROM w)"""


def cover_sql(keys: str) -> str:
    """CTEs from parted (keys, target_lang, text) and best (target_lang, candidate, translation) to covered (keys, text, translation, matched_text,
    match_type, consumed_words): the greedy walk is a recursion by position."""
    own = [k.strip() for k in keys.split(",")]
    also = "" if "target_lang" in own else ", target_lang"
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in own)
    kind = """CASE WHEN pos = 0 AND len = total AND variant = 0 THEN 'full' WHEN len > 1 THEN CASE WHEN variant = 0 THEN 'phrase' ELSE 'phrase-normalized' END
  ELSE CASE WHEN variant = 0 THEN 'word' ELSE 'word-normalized' END END"""
    return f"""ins AS (SELECT {keys}{also}, text, {words('text')} AS words, regexp_extract_all(text, {q(WORD)}) AS tokens FROM parted),
{candidate_sql('ins', keys + also)},
trace AS (SELECT {keys}, pos, len, variant, candidate AS matched, translation FROM cands JOIN best USING (target_lang, candidate) QUALIFY {TRACE.format(keys=keys)}),
plains AS (SELECT {keys}, CASE WHEN len(tokens) = len(words) THEN tokens ELSE words END AS plain, len(words) AS total FROM ins),
walk AS (SELECT {keys}, CAST(0 AS BIGINT) AS place, CAST([] AS VARCHAR[]) AS parts, '' AS matched, 'none' AS kind, CAST(0 AS INTEGER) AS consumed, total, plain FROM plains
  UNION ALL SELECT {', '.join('k.' + k for k in own)}, k.place + coalesce(t.len, 1), list_append(k.parts, coalesce(t.translation, k.plain[k.place + 1])),
    CASE WHEN k.kind = 'none' AND t.len IS NOT NULL THEN t.matched ELSE k.matched END, CASE WHEN k.kind = 'none' AND t.len IS NOT NULL THEN {kind} ELSE k.kind END,
    CASE WHEN k.kind = 'none' AND t.len IS NOT NULL THEN t.len ELSE k.consumed END, k.total, k.plain
  FROM walk k LEFT JOIN trace t ON {on('t', 'k')} AND t.pos = k.place WHERE k.place < k.total),
walked AS (SELECT * FROM walk WHERE place >= total),
covered AS (SELECT {', '.join('i.' + k for k in own)}, i.text, CASE WHEN f.len IS NOT NULL THEN f.translation ELSE array_to_string(k.parts, ' ') END AS translation,
  CASE WHEN f.len IS NOT NULL THEN f.matched ELSE k.matched END AS matched_text, CASE WHEN f.len IS NOT NULL THEN 'full' ELSE k.kind END AS match_type,
  CASE WHEN f.len IS NOT NULL THEN f.len ELSE k.consumed END AS consumed_words
  FROM ins i JOIN walked k ON {on('i', 'k')} LEFT JOIN trace f ON {on('i', 'f')} AND f.pos = 0 AND f.len = k.total)"""


def translate_sql(keys: str) -> str:
    """CTEs from inputs (keys, target_lang, text) and best to translated (keys, translation, matched_text, match_type, consumed_words)."""
    also = "" if "target_lang" in keys else ", target_lang"
    seg = f"{keys}, line_no, seg_no"
    word_list = "list_filter(regexp_split_to_array(o1, '[\\t-\\r ]+'), lambda w: w <> '')"
    return f"""split_ AS (SELECT {keys}{also}, string_split(coalesce(text, ''), chr(10)) AS l FROM inputs),
line_ AS (SELECT {keys}{also}, CAST(unnest(range(0, len(l))) AS INTEGER) AS line_no, unnest(l) AS line FROM split_),
content_ AS (SELECT {keys}{also}, line_no, {trim('line')} AS content FROM line_ WHERE {trim('line')} <> ''),
{sentence_sql('content_', keys + also + ', line_no', 'content')},
parted AS (SELECT {keys}{also}, line_no, seg_no, text FROM sentences),
{cover_sql(seg + also)},
f0 AS (SELECT {seg}, text, delimiter, translation, matched_text, match_type, consumed_words FROM covered JOIN sentences USING ({seg}{also}, text)),
f1 AS (SELECT *, CASE WHEN translation = '' THEN text ELSE translation END AS o1, {marks('text')} AS m FROM f0),
f2 AS (SELECT *, {word_list} AS ow FROM f1),
f3 AS (SELECT *, CASE WHEN match_type = 'full' OR len(m) = 0 OR len(ow) = 0 THEN o1 ELSE array_to_string(list_transform(ow, lambda w, i:
  CASE WHEN i <= len(m) AND NOT ends_with(w, m[i]) THEN w || m[i] ELSE w END), ' ') END AS o2 FROM f2),
f4 AS (SELECT *, CASE WHEN NOT {letters('text')} OR o2 = '' THEN o2 WHEN {caps('text')} THEN upper(replace(o2, 'ß', 'SS')) WHEN {starts_upper('text')} THEN {capital('o2')} ELSE o2 END AS o3,
  {opening('text')} AS lead_, {closing('text')} AS trail_ FROM f3),
f5 AS (SELECT *, CASE WHEN lead_ <> '' AND NOT starts_with(o3, lead_) THEN lead_ || o3 ELSE o3 END AS o4 FROM f4),
f6 AS (SELECT *, CASE WHEN trail_ <> '' AND NOT ends_with(o4, trail_) THEN o4 || trail_ ELSE o4 END AS o5 FROM f5),
f7 AS (SELECT {seg}, matched_text, match_type, consumed_words, {trim('o5 || delimiter')} AS out_ FROM f6),
g AS (SELECT {keys}, line_no, {trim("string_agg(out_, ' ' ORDER BY seg_no)")} AS inner_ FROM f7 GROUP BY {keys}, line_no),
h AS (SELECT {keys}, string_agg(CASE WHEN {trim('line')} = '' THEN line ELSE regexp_extract(line, '^{EDGE}*') || inner_ || regexp_extract(line, '{EDGE}*$') END, chr(10) ORDER BY line_no) AS translation
  FROM line_ LEFT JOIN g USING ({keys}, line_no) GROUP BY {keys}),
first_ AS (SELECT {keys}, matched_text, match_type, consumed_words FROM f7 WHERE match_type <> 'none' QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY line_no, seg_no) = 1),
translated AS (SELECT {keys}, translation, coalesce(matched_text, '') AS matched_text, coalesce(match_type, 'none') AS match_type, coalesce(consumed_words, 0) AS consumed_words FROM h LEFT JOIN first_ USING ({keys}))"""


SMALL_BEST = SMALL.replace("best AS (SELECT source_text", "best AS (SELECT target_lang, source_text")
EN_BEST = f"best AS (SELECT target_lang, source_text AS candidate, translated_text AS translation FROM built WHERE source_lang = 'en' QUALIFY {BEST})"
TO_TARGETS = "inputs AS (SELECT id, turn, target_lang, text FROM (SELECT conv_id AS id, turn, text FROM conversations UNION ALL SELECT item_id, -1, text FROM benchmark), (VALUES ('de'), ('es'), ('fr')) AS v(target_lang))"

ORACLE_SQL = {
    "norm_whitespace": text_sql(f"{ws('chr(32) || chr(9) || text || chr(10) || chr(32)')} AS norm"),
    "norm_lookup": text_sql(f"{norm('text')} AS norm"),
    "words": text_sql("array_to_string(w, '|') AS words, len(w) AS n", f", t AS (SELECT id, pos, {words('text')} AS w FROM texts)", "t"),
    "lookup_candidates": text_sql(
        "array_to_string(list_filter([array_to_string(w, ' '), CASE WHEN len(s) >= 2 AND len(s) < len(w) THEN array_to_string(s, ' ') END], lambda c: c IS NOT NULL AND c <> ''), '|') AS candidates",
        f", t AS (SELECT id, pos, {words('text')} AS w FROM texts), u AS (SELECT *, list_filter(w, lambda x: x NOT IN ('a', 'an', 'the', 'please', 'just')) AS s FROM t)", "u"),
    "split_sentences": text_sql(f"array_to_string({seg_list('text')}, '|') AS sentences"),
    "case_class": text_sql(f"{letters('text')} AS letters, {caps('text')} AS caps, {starts_upper('text')} AS upper_start"),
    "capitalize": text_sql(f"{CAPITAL} AS capital, CASE WHEN NOT {letters('text')} THEN 'xyz abc' WHEN {caps('text')} THEN 'XYZ ABC' WHEN {starts_upper('text')} THEN 'Xyz abc' ELSE 'xyz abc' END AS applied"),
    "word_tokens": text_sql(f"array_to_string(regexp_extract_all(text, {q(WORD)}), '|') AS tokens"),
    "inline_marks": text_sql(f"array_to_string({MARKS}, '|') AS marks"),
    "reapply_marks": text_sql(
        """CASE WHEN len(m) = 0 THEN 'um dois  três, quatro' ELSE array_to_string(list_transform(['um', 'dois', 'três,', 'quatro'], lambda w, i:
        CASE WHEN i <= len(m) AND NOT ends_with(w, m[i]) THEN w || m[i] ELSE w END), ' ') END AS marked""", f", t AS (SELECT id, pos, {MARKS} AS m FROM texts)", "t"),
    "wrappers": text_sql(f"{opening('text')} AS leading, {closing('text')} AS trailing"),
    "import_key": "SELECT page_id, sha256(url || '|' || url || '.b|en|pt_BR') AS import_key FROM pages",
    "lang_normalize": f"WITH {CODES} SELECT id, n, {canonical('code')} AS canonical FROM codes",
    "lang_variants": f"""WITH {CODES}, c AS (SELECT id, n, {canonical('code')} AS c, lower(translate({trim('code')}, '-', '_')) AS l FROM codes)
SELECT id, n, CASE WHEN c = '' THEN '' ELSE array_to_string(list_concat([c], CASE WHEN l <> c THEN [l] ELSE [] END, CASE WHEN c = 'pt_BR' THEN list_filter(['pt_br', 'pt'], lambda v: v <> l) ELSE [] END), '|') END AS variants FROM c""",
    "lang_token_valid": f"WITH {CODES} SELECT id, n, regexp_matches(code, {TOKEN}) AS valid FROM codes",
    "dataset_parse_name": f"{listing(PARSED)} SELECT file_name, corpus_name, lang_pair, language FROM h",
    "dataset_readable": f"{listing()} SELECT file_name, CAST(size AS BIGINT) AS size, {READABLE} AS readable FROM f",
    "dataset_coherent": f"""{listing()}, k AS (SELECT *, array_to_string(string_split(file_name, '.')[1:2], '.') AS pair FROM f)
SELECT a.file_name AS a, b.file_name AS b, (least(a.size, b.size) >= 8 AND CAST(greatest(a.size, b.size) AS DOUBLE) / least(a.size, b.size) <= 10.0) AS coherent FROM k a JOIN k b USING (pair)""",
    "dataset_scan": f"""{listing(PARSED)}, ok AS (SELECT * FROM h WHERE {READABLE})
SELECT s.corpus_name, {canonical('s.src')} AS source_language, {canonical('s.tgt')} AS target_language, s.file_name AS source_file, t.file_name AS target_file
FROM ok s JOIN ok t ON s.corpus_name = t.corpus_name AND s.lang_pair = t.lang_pair AND s.language = s.src AND t.language = t.tgt AND s.src <> s.tgt
WHERE CAST(greatest(s.size, t.size) AS DOUBLE) / least(s.size, t.size) <= 10.0""",
    "moses_zip": f"WITH {FILES} SELECT corpus AS corpus_name, target AS target_language, CAST(n AS BIGINT) AS line_no, source_raw, target_raw FROM filed",
    "moses_misaligned": f"""WITH {FILES}, n AS (SELECT corpus, target, count(*) AS lines FROM filed GROUP BY ALL)
SELECT a.corpus AS corpus_name, a.target AS source_of, b.target AS target_language, a.lines AS source_lines, b.lines AS target_lines, a.lines = b.lines AS aligned FROM n a JOIN n b USING (corpus)""",
    "bidirectional_pairs": f"WITH {PARALLEL} SELECT * FROM raw_pairs",
    "filter_len": f"WITH {FILTER_INPUTS} SELECT kind, id, pos, (text = '' OR {bad_length('text')}) AS hit FROM inputs1",
    **{f"filter_{n}": f"WITH {FILTER_INPUTS} SELECT kind, id, pos, {has('text', p)} AS hit FROM inputs1" for n, p in TECHNICAL.items()},
    "filter_symbols": f"WITH {FILTER_INPUTS} SELECT kind, id, pos, {symbols('text', 0.35, 4)} AS hit FROM inputs1",
    "filter_strange": f"WITH {FILTER_INPUTS}, p AS (SELECT *, {pieces('text')} AS ps FROM inputs1) SELECT kind, id, pos, {strange('text', 'ps')} AS hit FROM p",
    "cleanup_control": f"WITH {FILTER_INPUTS} SELECT kind, id, pos, {control('text')} AS hit FROM inputs2",
    "cleanup_junk": f"WITH {FILTER_INPUTS} SELECT kind, id, pos, {junk('text')} AS hit FROM inputs2",
    "cleanup_symbols": f"WITH {FILTER_INPUTS} SELECT kind, id, pos, {stored_symbols('text')} AS hit FROM inputs2",
    "cleanup_broken": f"WITH {FILTER_INPUTS}, p AS (SELECT *, {pieces('text')} AS ps FROM inputs2) SELECT kind, id, pos, {broken('text', 'ps')} AS hit FROM p",
    "filter_same": f"""WITH {PARALLEL} SELECT target_lang, line_no, ({norm('source_raw')} <> '' AND {norm('source_raw')} = {norm('target_raw')}) AS hit FROM parallel
UNION ALL SELECT 'lit', i, ({norm('source')} <> '' AND {norm('source')} = {norm('target')}) FROM {values(fx.PAIRS, 'source, target')}""",
    "import_pair_rules": f"""WITH {PARALLEL}, c AS (SELECT target_lang, line_no, {ws('source_raw')} AS s, {ws('target_raw')} AS t FROM
  (SELECT target_lang, line_no, source_raw, target_raw FROM parallel UNION ALL SELECT 'lit', i, source, target FROM {values(fx.PAIRS, 'source, target')})), p AS (SELECT *, {pieces('s')} AS ps, {pieces('t')} AS pt FROM c)
SELECT target_lang, line_no, NOT {rejected('s', 't', 'ps', 'pt')} AS valid FROM p""",
    "cleanup_pair_rules": f"""WITH {UNFILTERED}, c AS (SELECT source_lang, target_lang, line_no, source_text AS s, translated_text AS t FROM unfiltered UNION ALL SELECT 'lit', 'lit', i, source, target FROM {values(fx.STORED, 'source, target')}),
p AS (SELECT *, {pieces('s')} AS ps, {pieces('t')} AS pt FROM c) SELECT source_lang, target_lang, line_no, {invalid('s', 't', 'ps', 'pt')} AS invalid FROM p""",
    "import_pipeline": f"WITH {IMPORTED} SELECT * FROM imported",
    "import_stats": f"""WITH {IMPORTED}, n AS (SELECT count(*) AS n, count(DISTINCT ({KEY})) AS d FROM imported), r AS (SELECT count(*) AS r FROM raw_pairs)
SELECT r AS processed, d AS inserted, n - d AS updated_frequency, r - n AS ignored, n - d AS duplicate, CAST(0 AS BIGINT) AS resumed FROM n, r""",
    "phrase_table_build": f"WITH {BUILT} SELECT * FROM built",
    "best_translation": f"WITH {BUILT} SELECT source_lang, target_lang, source_text, translated_text, frequency, id FROM built QUALIFY {BEST}",
    "find_translation": f"WITH {BUILT} SELECT source_text, translated_text FROM built WHERE source_lang = 'en' AND target_lang = 'de' AND source_text IN (SELECT {norm('seg')} FROM segments WHERE lang = 'en') QUALIFY {BEST}",
    "duplicate_rows": f"WITH {MERGED} SELECT CAST(coalesce(sum(frequency - 1), 0) AS BIGINT) AS duplicates FROM merged",
    "merge_duplicates": f"WITH {MERGED} SELECT {KEY}, 2 * frequency AS frequency FROM merged",
    "legacy_frequency": f"{LEGACY} SELECT {KEY}, count(*) AS frequency FROM t GROUP BY ALL",
    "normalize_stored_langs": f"{LEGACY} SELECT source_text, translated_text, {canonical('source_lang')} AS source_lang, {canonical('target_lang')} AS target_lang, count(*) AS frequency FROM t GROUP BY ALL",
    "cleanup_invalid": f"WITH {UNFILTERED}, p AS (SELECT *, {pieces('source_text')} AS ps, {pieces('translated_text')} AS pt FROM built) SELECT id, {KEY}, frequency FROM p WHERE NOT {invalid('source_text', 'translated_text', 'ps', 'pt')}",
    "cleanup_stats": f"""WITH {UNFILTERED}, p AS (SELECT *, {pieces('source_text')} AS ps, {pieces('translated_text')} AS pt FROM counted), b AS (SELECT frequency, {invalid('source_text', 'translated_text', 'ps', 'pt')} AS bad FROM p)
SELECT CAST(coalesce(sum(frequency) FILTER (bad), 0) AS BIGINT) AS removed_invalid_entries, CAST(coalesce(sum(frequency - 1) FILTER (NOT bad), 0) AS BIGINT) AS removed_duplicates, count(*) FILTER (NOT bad) AS final_translations_count FROM b""",
    "table_summary": f"WITH {MERGED} SELECT count(*) AS translation_count, CAST(coalesce(sum(frequency), 0) AS BIGINT) AS total_frequency FROM merged",
    "pair_summary": f"""WITH {MERGED}, s AS (SELECT source_lang, target_lang, count(*) AS translation_count, CAST(sum(frequency) AS BIGINT) AS total_frequency FROM merged GROUP BY ALL)
SELECT *, source_lang || ' -> ' || target_lang || ' (' || translation_count || ' pares, frequência ' || total_frequency || ')' AS line FROM s ORDER BY source_lang, target_lang LIMIT 20""",
    "available_languages": f"WITH {IMPORTED} SELECT source_lang AS lang FROM imported UNION SELECT target_lang FROM imported",
    "available_pairs": f"WITH {MERGED} SELECT source_lang, target_lang, count(*) AS translation_count FROM merged GROUP BY ALL",
    "has_pair": f"""WITH {IMPORTED}, a(source_lang, target_lang) AS (VALUES ('en', 'de'), ('EN-gb', 'fr'), ('de', 'fr'), ('', 'en'))
SELECT a.source_lang, a.target_lang, EXISTS (SELECT 1 FROM imported m WHERE m.source_lang = {canonical('a.source_lang')} AND m.target_lang = {canonical('a.target_lang')}) AS found FROM a""",
    "import_progress": """WITH p AS (SELECT sha256(url || '|' || url || '|en|de') AS import_key, max(page_id) AS processed_lines, bool_and(page_id % 2 = 0) AS completed FROM pages WHERE url IS NOT NULL AND page_id % 3 <> 0 GROUP BY 1),
a AS (SELECT sha256(url || '|' || url || '|en|de') AS import_key FROM pages WHERE url IS NOT NULL UNION SELECT sha256(url || '|' || url || '|en|fr') FROM pages WHERE url IS NOT NULL)
SELECT a.import_key, processed_lines, completed, p.import_key IS NOT NULL AS found FROM a LEFT JOIN p USING (import_key)""",
    "line_split": f"""WITH t AS (SELECT doc_id AS id, string_split(text, chr(10)) AS l FROM documents UNION ALL SELECT -i - 1, string_split(text, chr(10)) FROM {values(fx.LINES, 'text')}),
u AS (SELECT id, CAST(unnest(range(0, len(l))) AS INTEGER) AS line_no, unnest(l) AS line FROM t)
SELECT id, line_no, regexp_extract(line, '^{EDGE}*') AS lead, {trim('line')} AS content, CASE WHEN {trim('line')} = '' THEN '' ELSE regexp_extract(line, '{EDGE}*$') END AS trail FROM u""",
    "sentence_segments": f"""WITH t AS (SELECT conv_id AS id, turn, text FROM conversations UNION ALL SELECT -i - 1, 0, text FROM {values(fx.SEGMENTS, 'text')}),
{sentence_sql('t', 'id, turn', 'text')} SELECT * FROM sentences""",
    "ngram_candidates": f"""WITH b0 AS (SELECT item_id AS id, {seg_list('text')} AS l FROM benchmark), b AS (SELECT id, unnest(range(0, len(l))) AS seg, unnest(l) AS text FROM b0
  UNION ALL SELECT -i - 1, 0, text FROM {values(fx.INPUTS, 'text')}), ins AS (SELECT id, seg, {words('text')} AS words FROM b), {candidate_sql('ins', 'id, seg')} SELECT * FROM cands""",
    "best_match_at_pos": f"{SMALL_TRACE} SELECT * FROM trace",
    "match_type": f"""{SMALL_TRACE} SELECT id, seg, pos, trace.len AS len, CASE WHEN pos = 0 AND trace.len = len(ins.words) AND variant = 0 THEN 'full' WHEN trace.len > 1 THEN CASE WHEN variant = 0 THEN 'phrase' ELSE 'phrase-normalized' END
ELSE CASE WHEN variant = 0 THEN 'word' ELSE 'word-normalized' END END AS match_type FROM trace JOIN ins USING (id, seg)""",
    "match_trace": f"""WITH {BUILT}, {EN_BEST}, {TO_TARGETS}, ins AS (SELECT id, turn, target_lang, {words('text')} AS words FROM inputs), {candidate_sql('ins', 'id, turn, target_lang')}
SELECT id, turn, target_lang, pos, len, variant, candidate AS matched, translation FROM cands JOIN best USING (target_lang, candidate) QUALIFY {TRACE.format(keys='id, turn, target_lang')}""",
    "translate_segments": f"""WITH RECURSIVE {SMALL_BEST},
parted AS (SELECT id, seg, 'pt_BR' AS target_lang, text FROM {SMALL_PARTS}), {cover_sql('id, seg')}
SELECT id, seg, translation, matched_text, match_type, consumed_words FROM covered""",
    "translate_literals": f"""WITH RECURSIVE {SMALL_BEST},
inputs AS (SELECT item_id AS id, 'pt_BR' AS target_lang, text FROM benchmark UNION ALL SELECT -i - 1, 'pt_BR', text FROM {values(fx.INPUTS, 'text')}), {translate_sql('id')} SELECT * FROM translated""",
    "translate_text": f"WITH RECURSIVE {BUILT}, {EN_BEST}, {TO_TARGETS}, {translate_sql('id, turn, target_lang')} SELECT * FROM translated",
    "upsert": f"""WITH {EXISTING}, gained AS (SELECT e.id, {', '.join('e.' + k.strip() for k in KEY.split(','))}, e.frequency + coalesce(f.frequency, 0) AS frequency FROM existing e LEFT JOIN fresh f USING ({KEY})),
new_ AS (SELECT * FROM fresh ANTI JOIN existing USING ({KEY})),
added AS (SELECT (SELECT coalesce(max(id), 0) FROM existing) + row_number() OVER (ORDER BY first_line, {KEY}) AS id, {KEY}, frequency FROM new_)
SELECT * FROM gained UNION ALL SELECT * FROM added""",
    "import_stats_existing": f"""WITH {EXISTING}, n AS (SELECT count(*) AS n FROM imported), d AS (SELECT count(*) AS d FROM fresh ANTI JOIN existing USING ({KEY})), r AS (SELECT count(*) AS r FROM raw_pairs)
SELECT r AS processed, d AS inserted, n - d AS updated_frequency, r - n AS ignored, n - d AS duplicate, CAST(0 AS BIGINT) AS resumed FROM n, d, r""",
}
