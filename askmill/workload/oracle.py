"""SQL that gives the rows of each query, for an independent engine over the same tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# Named building blocks; a block may use those it names in front of its SQL.
BLOCKS: dict[str, tuple[str, str]] = {}


def block(name: str, uses: str, sql: str) -> None:
    BLOCKS[name] = (uses, sql)


def oracle(name: str, uses: str, sql: str, recursive: bool = False) -> None:
    needed: list[str] = []

    def add(block_name: str) -> None:
        if block_name not in needed:
            for below in BLOCKS[block_name][0].split():
                add(below)
            needed.append(block_name)

    for used in uses.split():
        add(used)
    parts = [f"{n} AS ({BLOCKS[n][1]})" for n in needed]
    ORACLE[name] = (f"WITH RECURSIVE {', '.join(parts)} {sql}" if parts else sql).strip()


WORDS = r"'[\p{L}\p{Nd}_]+'"
PIECES = r"'([\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_]+)'"
# The patterns whose matches the results are defined by.
VERSION = r"'(?i)((javac?)|(jdk)) ?(v(ersion)?)? ?1.([1-9])(.[\d_]+)?'"
LANG = r"'java\.lang\.([a-zA-Z]+(Exception|Bounds|Error))'"
IO = r"'java\.io\.([a-zA-Z]+(Exception|Error))'"
START = "epoch_us(TIMESTAMP '2024-01-01 00:00:00')"


def stats_of(tokens: str, docs: str) -> str:
    """Statistics of a block of (doc_id, term) occurrences, over the documents of a table."""
    counts = f"SELECT term, count(*) ctf, count(DISTINCT doc_id) df FROM {tokens} GROUP BY term"
    return f"""SELECT term, ctf, df, ln((SELECT count(*) FROM {docs})::DOUBLE / df) idf,
        ln((SELECT count(*) FROM {tokens})::DOUBLE / ctf) ictf FROM ({counts})"""


# texts

block("sources", "", """SELECT p_partkey file_id, 'import ' || replace(p_name, ' ', '.') || '.' || p_type || ';'
    || chr(10) || '// ' || p_brand || chr(10) || 'import ' || p_type || ';/* ' || p_brand || chr(10)
    || '*/ end' AS text, p_size AS size FROM part""")
block("contexts", "sources", """SELECT conv_id || ':' || turn context_id, text, (turn % 3)::INT caret_line,
    CASE WHEN conv_id % 2 = 1 THEN text END selected FROM conversations
    UNION ALL SELECT 'file:' || file_id, text, (size % 4)::INT, NULL FROM sources""")
block("context_base", "contexts", r"""SELECT *, NOT regexp_matches(coalesce(selected, ''), '[^\x00-\x20]') blank,
    CASE WHEN text = '' OR rtrim(text, chr(10)) <> ''
         THEN string_split(rtrim(text, chr(10)), chr(10))[caret_line + 1] END line,
    list_distinct(regexp_extract_all(text, 'import\s+([\w.]*\w);', 1)) imports FROM contexts""")
block("context_terms", "context_base", f"""
    SELECT context_id, unnest(string_split(lower(imported), '.')) term, 1 weight
      FROM (SELECT context_id, unnest(imports) imported FROM context_base WHERE blank)
    UNION ALL
    SELECT context_id, unnest(CASE WHEN line = '' THEN [''] ELSE regexp_extract_all(lower(line), {PIECES}) END), 2
      FROM context_base WHERE blank AND line IS NOT NULL
    UNION ALL
    SELECT context_id, unnest(regexp_extract_all(lower(selected), {PIECES})), 2
      FROM context_base WHERE NOT blank""")
block("doc_tokens", "", f"SELECT doc_id, unnest(regexp_extract_all(lower(text), {WORDS})) term FROM documents")
block("doc_stats", "doc_tokens", stats_of("doc_tokens", "documents"))
block("name_tokens", "", "SELECT p_partkey doc_id, unnest(string_split(p_name, ' ')) term FROM part")
block("name_stats", "name_tokens", stats_of("name_tokens", "part"))
block("parts", "", """SELECT p_partkey post_id, p_name title, CASE WHEN p_size % 3 > 0 THEN p_brand END body,
    CASE WHEN p_size % 7 > 0 THEN string_split(lower(p_name || ' ' || p_type), ' ') END tags,
    CASE WHEN p_size % 5 > 0 THEN 'p/' || p_partkey END link, p_size votes, p_partkey * 86400 created,
    p_size * 86400 active, p_partkey % 4 answers, p_size % 2 = 0 accepted, p_brand AS "user" FROM part""")
block("tagged_parts", "", """SELECT p_partkey post_id, string_split(lower(p_name || ' ' || p_type), ' ') tags FROM part""")
block("tag_tokens", "tagged_parts", "SELECT post_id doc_id, unnest(tags) term FROM tagged_parts")
block("tag_stats", "tag_tokens", stats_of("tag_tokens", "part"))
block("some_tag_tokens", "parts", "SELECT post_id doc_id, unnest(tags) term FROM parts")
block("some_tag_stats", "some_tag_tokens", stats_of("some_tag_tokens", "part"))

ROUNDED = "term, ctf, df, round(idf, 6) idf, round(ictf, 6) ictf"

# sources and sinks

oracle("read_term_stats", "name_stats", f"""SELECT {ROUNDED}, (SELECT count(*) FROM name_tokens) term_count,
    (SELECT count(*) FROM part) doc_count FROM name_stats""")
oracle("read_tag_stats", "tag_stats", "SELECT term, ctf, ctf df, round(idf, 6) idf, round(ictf, 6) ictf FROM tag_stats")
block("saved", "parts", "SELECT *, post_id // 20 n FROM parts")
oracle("read_responses", "saved", """
    SELECT n % 2 = 0 has_more, 100 quota_max, (n % 100)::INT quota_remaining,
      (row_number() OVER (PARTITION BY n ORDER BY post_id) - 1)::INT initial_rank, post_id,
      coalesce(array_to_string(tags, '|'), '') tags, coalesce(body, '') body, title,
      coalesce(link, 'http://www.stackoverflow.com/') link,
      coalesce(list_reduce([''] || [('[' || x || '] ') FOR x IN tags], lambda a, b: a || b), '') tag_text
    FROM saved
    UNION ALL
    SELECT DISTINCT false, 100, (n % 100)::INT, NULL::INT, NULL::BIGINT, NULL, NULL, NULL, NULL, NULL
    FROM saved WHERE n % 10 = 0""")


def code(text: str) -> str:
    """The signed 32-bit string hash of text whose characters are single code units."""
    raw = f"""list_reduce([0::BIGINT] || CASE WHEN {text} = '' THEN []::BIGINT[]
        ELSE [unicode(c)::BIGINT FOR c IN string_split({text}, '')] END, lambda h, u: (h * 31 + u) % 4294967296)"""
    return f"(CASE WHEN {raw} >= 2147483648 THEN {raw} - 4294967296 ELSE {raw} END)::INT"


block("searches", "", """SELECT user_id, event_id seq, CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type END query,
    CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type || ' ' || props END tags, event_id % 3 > 0 manual,
    event_id % 17 = 0 replay,
    CASE WHEN event_id % 3 > 0 THEN 'manual' WHEN event_type = 'error' THEN 'runtime'
         WHEN event_type = 'view' THEN 'compiler' WHEN event_type = 'click' THEN 'difficulty' ELSE 'action' END query_type,
    CASE WHEN event_id % 2 = 0 THEN 'RELEVANCE' ELSE 'VOTES' END sort, event_id % 5 > 0 visible FROM events""")
block("tag_codes", "searches", f"""SELECT seq, string_agg({code('tag')}::VARCHAR, '|' ORDER BY n) codes, count(*) n_tags
    FROM (SELECT seq, unnest(string_split(tags, ' ')) tag, generate_subscripts(string_split(tags, ' '), 1) n FROM searches)
    GROUP BY seq""")
block("query_events", "searches tag_codes", """SELECT user_id, seq, query_type AS QueryEventType,
    CASE WHEN hidden THEN NULL ELSE codes END AS Tags, CASE WHEN NOT hidden THEN lower(sort) END sort,
    CASE WHEN hidden THEN 'false' END Visible, n_tags
    FROM (SELECT *, query_type IN ('compiler', 'runtime') AND NOT visible hidden FROM searches) JOIN tag_codes USING (seq)""")
block("settings", "", """SELECT DISTINCT user_id, user_id % 2 > 0 auto_query, user_id % 3 > 0 runtime_error,
    user_id % 5 > 0 compile_error, user_id % 7 > 0 difficulty, user_id % 11 > 0 logging FROM events WHERE user_id % 13 > 0""")
block("generous", "", """SELECT DISTINCT user_id, user_id % 9 > 0 auto_query, user_id % 8 > 0 runtime_error,
    user_id % 5 > 0 compile_error, user_id % 7 > 0 difficulty, user_id % 11 > 0 logging FROM events WHERE user_id % 13 > 0""")
block("visible", "", "SELECT DISTINCT user_id FROM events WHERE user_id % 4 > 0")


def gate(flag: str, settings: str = "settings") -> str:
    return f"user_id NOT IN (SELECT user_id FROM {settings} WHERE NOT (auto_query AND {flag}))"


oracle("write_telemetry", "query_events settings", f"""SELECT user_id::VARCHAR "User", '-941403937' ProjectCode,
    'test' Environment, QueryEventType, Tags, sort, Visible FROM query_events WHERE {gate('logging')}""")
for name in ("read_log_batches", "log_batch_stream"):
    oracle(name, "query_events", """SELECT user_id::VARCHAR "User", QueryEventType, sort, count(*) events,
    sum(CASE WHEN Tags IS NULL THEN NULL ELSE n_tags END)::BIGINT tags FROM query_events GROUP BY ALL""")

for name in ("log_events_once", "log_events_once_stream"):
    # of a user's envelopes, those of equal text are one
    oracle(name, "query_events", """SELECT user_id::VARCHAR "User", e.QueryEventType, e.Tags, e.sort FROM (
      SELECT user_id, unnest(logs) e FROM (SELECT DISTINCT user_id, logs FROM (
        SELECT user_id, list({'QueryEventType': QueryEventType, 'Tags': Tags, 'sort': sort} ORDER BY seq) logs
        FROM query_events GROUP BY user_id, seq // 50)))""")
oracle("dead_letters", "", """SELECT DISTINCT '{"Logs": [{"User":"' || user_id || '"' AS value FROM events""")

block("messages_raw", "", """SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') run_id, user_id, event_id, event_type,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARNING' ELSE 'INFORMATION' END category,
    ['small', 'zzz', 'ring', 'cold', 'anvil', 'red', 'yyy'][event_id % 7 + 1] word, props FROM events""")
block("messages", "messages_raw", """SELECT run_id, user_id, category,
    CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN word || ':' || chr(10) || 'blue bolt'
         WHEN event_type = 'error' THEN 'java.io.IOException: ' || props || chr(10) || word || ';' || chr(10) || 'java.lang.Error'
         WHEN event_type = 'view' THEN 'Javac v 1.' || (event_id % 9 + 1) ELSE 'done' END AS text,
    row_number() OVER (PARTITION BY run_id, category ORDER BY event_id) - 1 pos FROM messages_raw""")
oracle("read_compiler_messages", "messages",
       "SELECT * FROM messages WHERE run_id IN (SELECT run_id FROM messages WHERE category = 'ERROR')")

block("raw_edits", "", """SELECT user_id, event_id, ts,
    CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'scroll' ELSE 'change' END AS "action",
    CASE WHEN event_type = 'error' OR event_id % 5 = 0 THEN props ELSE '' END old_text,
    CASE WHEN event_type IN ('purchase', 'signup') THEN props ELSE '' END new_text,
    CASE WHEN event_id % 3 > 0 THEN floor(value) END old_center, floor(value / 2 + 1) new_center FROM events""")
block("classified", "raw_edits", """SELECT user_id, event_id, epoch_us(ts) ts, kind,
      CASE kind WHEN 'Insert' THEN new_text WHEN 'Delete' THEN old_text END AS text
    FROM (SELECT *, CASE WHEN "action" = 'change' AND old_text = '' AND new_text <> '' THEN 'Insert'
                         WHEN "action" = 'change' AND old_text <> '' AND new_text = '' THEN 'Delete'
                         WHEN "action" = 'scroll' AND old_center <> new_center THEN 'Scroll'
                         WHEN "action" = 'click' THEN 'Click' END kind FROM raw_edits) WHERE kind IS NOT NULL""")
oracle("editor_event_stream", "classified", "SELECT * FROM classified")
oracle("classify_editor_events", "classified", "SELECT * FROM classified")

# projections

oracle("clean_posts", "parts", """SELECT post_id, title, coalesce(body, '') body, coalesce(array_to_string(tags, '|'), '') tags,
    coalesce(link, 'http://www.stackoverflow.com/') link,
    coalesce(list_reduce([''] || [('[' || x || '] ') FOR x IN tags], lambda a, b: a || b), '') tag_text FROM parts""")
block("sentences", "", """SELECT item_id, unnest(string_split(text, '.')) sentence,
    generate_subscripts(string_split(text, '.'), 1) - 1 n FROM benchmark""")
block("requests", "sentences", """SELECT item_id || ':' || n request_id, item_id user_id,
    CASE WHEN string_split(trim(sentence, ' '), ' ')[1] <> ''
         THEN ' <scr<script>ipt>{' || trim(sentence, ' ') || '}</script> ' ELSE '' END q,
    CASE WHEN (item_id + n) % 3 = 0 THEN ['en'] ELSE []::VARCHAR[] END tags,
    ['relevance', 'relevance', 'votes', 'newest', 'active'][n % 5 + 1] sort, (item_id + n) % 2 = 0 backoff FROM sentences""")


def unmarked(text: str) -> str:
    for _ in range(2):
        text = f"replace(replace({text}, '<script>', ''), '</script>', '')"
    return text


block("ready", "requests", f"""SELECT *, {unmarked('q')} clean_q, CASE WHEN tags = [] THEN '' ELSE '[en]' END tag_query,
    array_to_string(tags, ' ') tag_text FROM requests WHERE {unmarked('q')} <> '' OR tags <> []""")
oracle("normalise_requests", "ready", """SELECT request_id, user_id, q, array_to_string(tags, '|') tags, sort, backoff,
    clean_q, tag_query, tag_text, trim(replace(replace(clean_q || ' ' || tag_query, '{', ''), '}', ''), ' ' || chr(10)) sent_q,
    'stackoverflow' site FROM ready""")
oracle("filter_posts", "parts", """SELECT post_id, title, votes FROM parts
    WHERE list_has_any(tags, ['ring', 'bolt', 'gear']) AND NOT list_contains(tags, 'cold') AND created >= 864000
      AND votes BETWEEN 5 AND 40 AND answers >= 1 AND title LIKE '%l%' AND accepted""")
oracle("filter_posts_page", "parts", """SELECT post_id, body FROM parts WHERE body LIKE '%Brand#1%' AND created <= 86400000
    ORDER BY created DESC, post_id LIMIT 25 OFFSET 25""")
block("full_posts", "", """SELECT p_partkey post_id, p_name title, CASE WHEN p_size % 3 > 0 THEN p_brand END body,
    CASE WHEN p_size % 7 > 0 THEN string_split(lower(p_name || ' ' || p_type), ' ') END tags, p_size votes, p_retailprice relevance,
    p_partkey * 86400 created, p_size * 86400 active, p_partkey % 4 answers, p_partkey % 1000 views, p_brand owner,
    'site' || (p_partkey % 3) site, CASE WHEN p_size % 5 > 0 THEN 'p/' || p_partkey END url,
    [p_size % 2 = 0, p_size % 3 = 0, p_partkey % 5 = 0, p_size % 11 = 0, p_partkey % 7 > 0] flags FROM part""")
# a customer's key k says which components its request has
block("browsed", "full_posts", """SELECT c_custkey request_id, k, p.*,
      CASE k % 4 WHEN 0 THEN relevance WHEN 1 THEN votes WHEN 2 THEN created ELSE active END AS value
    FROM (SELECT *, c_custkey k, CASE WHEN c_custkey % 4 > 1 THEN 86400 ELSE 1 END AS unit FROM customer) c JOIN full_posts p ON
      (k % 3 <> 0 OR list_has_any(tags, ['ring', 'bolt'])) AND (k % 5 <> 0 OR NOT list_contains(tags, 'cold'))
      AND (k % 2 <> 0 OR created >= k % 50 * 86400) AND (k % 3 <> 1 OR created <= (k % 50 + 100) * 86400)
      AND (k % 4 = 0 OR k % 7 <> 1 OR CASE k % 4 WHEN 1 THEN votes WHEN 2 THEN created ELSE active END >= k % 20 * unit)
      AND (k % 4 = 0 OR k % 7 <> 2 OR CASE k % 4 WHEN 1 THEN votes WHEN 2 THEN created ELSE active END <= (k % 20 + 20) * unit)
      AND (k % 6 <> 1 OR answers >= k % 4) AND (k % 8 <> 3 OR views >= k % 500)
      AND (k % 9 <> 4 OR contains(body, 'Brand#' || (k % 5 + 1))) AND (k % 10 <> 5 OR contains(title, 'l'))
      AND (k % 11 <> 6 OR contains(url, 'p/1')) AND (k % 12 <> 7 OR owner = 'Brand#13') AND (k % 13 <> 3 OR site = 'site' || (k % 3))
      AND (k % 7 IN (1, 2) OR flags[CASE k % 7 WHEN 0 THEN 5 ELSE k % 7 - 2 END] = (k % 2 = 0))""")
oracle("filter_for_requests", "browsed", """SELECT request_id, position, post_id, title FROM (
      SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN k % 3 = 2 THEN value ELSE -value END, post_id) - 1 AS position,
        CASE WHEN k % 4 = 1 THEN 7 ELSE 30 END AS size FROM browsed)
    WHERE (k % 20 = 0 AND k % 4 <> 1) OR position BETWEEN CASE WHEN k % 20 = 0 THEN 0 ELSE k % 3 END * size
      AND (CASE WHEN k % 20 = 0 THEN 0 ELSE k % 3 END + 1) * size - 1""")
block("kinds", "", """SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN 'Scroll'
    WHEN 'error' THEN 'Delete' ELSE 'Insert' END kind FROM events""")


def editor(speed: int) -> str:
    return f"SELECT user_id, event_id, {START} + (epoch_us(ts) - {START}) // {speed} ts, kind FROM kinds"


block("editor", "kinds", editor(1))
block("editor_fast", "kinds", editor(10_000))
block("editor_slow", "kinds", editor(50))
oracle("settings_gate", "editor settings", f"SELECT * FROM editor WHERE {gate('runtime_error')}")
block("setting_changes", "", """SELECT user_id, epoch_us(ts) ts, event_id seq, event_id % 9 > 0 auto_query, event_id % 3 > 0 runtime_error,
    event_id % 4 > 0 difficulty FROM events WHERE event_type = 'purchase'""")
block("window_changes", "", """SELECT user_id, epoch_us(ts) ts, event_id seq, event_id % 7 > 0 AND event_id % 3 > 0 visible
    FROM events WHERE event_type = 'signup'""")


def as_of(value: str, changes: str, default: str, event: str = "e") -> str:
    return f"""coalesce((SELECT arg_max({value}, (c.ts // 1000, c.seq)) FROM {changes} c
        WHERE c.user_id = {event}.user_id AND c.ts // 1000 <= {event}.ts // 1000), {default})"""


AS_OF = as_of("auto_query AND runtime_error", "setting_changes", "TRUE")
oracle("settings_gate_as_of", "editor setting_changes", f"SELECT * FROM editor e WHERE {AS_OF}")
oracle("settings_gate_as_of_stream", "editor setting_changes", f"""SELECT * FROM editor e WHERE {AS_OF} AND ts // 1000 <=
    least((SELECT max(ts) // 1000 FROM editor), (SELECT max(ts) // 1000 FROM setting_changes))""")
oracle("window_gate_as_of", "editor window_changes", f"SELECT * FROM editor e WHERE {as_of('visible', 'window_changes', 'FALSE')}")
oracle("strip_comments", "sources", r"""SELECT file_id,
    regexp_replace(text, '(//[^\n]*\n)|(/\*[^\r]*?\*/)', '', 'g') AS text FROM sources""")
oracle("extract_imports", "context_base", r"""SELECT file_id, array_to_string(list_filter(found, lambda x, i:
    list_position(found, x) = i), '|') imports
    FROM (SELECT file_id, regexp_extract_all(text, 'import\s+([\w.]*\w);', 1) found FROM sources)""")
oracle("context_terms", "context_terms", "SELECT * FROM context_terms")
block("versions", "messages", f"""SELECT run_id, category, pos, unnest(found) "match",
    (generate_subscripts(found, 1) - 1)::INT nth
    FROM (SELECT *, regexp_extract_all(text, {VERSION}, 6) found FROM messages)""")
oracle("find_patterns", "versions", "SELECT * FROM versions")
block("ordered_text", "messages", """SELECT run_id, string_agg(text, chr(10) ORDER BY
    list_position(['ERROR', 'WARNING', 'INFORMATION'], category), pos) AS text FROM messages GROUP BY run_id""")
oracle("find_patterns_in_blocks", "ordered_text", f"""SELECT run_id, 0 part,
    array_to_string(regexp_extract_all(text, {VERSION}, 6), '|') versions,
    array_to_string(regexp_extract_all(text, {LANG}, 1), '|') lang,
    array_to_string(regexp_extract_all(text, {IO}, 1), '|') io FROM ordered_text""")
oracle("first_line", "messages", """SELECT run_id,
    replace(string_split(arg_min(text, pos) FILTER (category = 'ERROR'), chr(10))[1], ':', '') first_line
    FROM messages GROUP BY run_id""")


def keyword_blocks(prefix: str, messages: str, kind: str, stats: str, split: str) -> str:
    """Blocks for the keywords of runs; the last one is `<prefix>keywords`."""
    block(f"{prefix}candidates", f"{messages} {stats}", f"""
        SELECT run_id, 1 src, 1 maj, pos, generate_subscripts(found, 1) n, unnest(found) word
          FROM (SELECT *, regexp_extract_all(text, {LANG}, 1) found FROM {messages} WHERE category = 'ERROR')
        UNION ALL SELECT run_id, 2, 1, pos, generate_subscripts(found, 1), unnest(found)
          FROM (SELECT *, regexp_extract_all(text, {IO}, 1) found FROM {messages} WHERE category = 'ERROR')
        UNION ALL SELECT run_id, 3, list_position(['ERROR', 'WARNING', 'INFORMATION'], category), pos,
            generate_subscripts(found, 1), unnest(['java ' || v FOR v IN found])
          FROM (SELECT *, regexp_extract_all(text, {VERSION}, 6) found FROM {messages})
        UNION ALL SELECT * FROM (SELECT run_id, 4, 1, pos, generate_subscripts(found, 1), unnest(found) word
          FROM (SELECT *, string_split_regex(translate(text, ':;"''', ''), {split}) found
                FROM {messages} WHERE category = 'ERROR')) WHERE word IN (SELECT term FROM {stats})""")
    block(f"{prefix}ranked", f"{prefix}candidates", f"""SELECT run_id, word, row_number() OVER (PARTITION BY run_id
        ORDER BY min(row(src, maj, pos, n))) place FROM {prefix}candidates WHERE word <> '{kind}' GROUP BY run_id, word""")
    block(f"{prefix}keywords", f"{prefix}ranked", f"""SELECT run_id, '{kind}' || coalesce(' ' || string_agg(word, ' '
        ORDER BY place), '') keywords
        FROM (SELECT DISTINCT run_id FROM {messages} WHERE category = 'ERROR')
        LEFT JOIN (SELECT * FROM {prefix}ranked WHERE place <= 9) USING (run_id) GROUP BY run_id""")
    return f"{prefix}keywords"


LINES, SPACES = "chr(10)", "'[ \\n]+'"
oracle("error_keywords", keyword_blocks("c_", "messages", "compile error", "name_stats", LINES), "SELECT * FROM c_keywords")
oracle("error_keywords_by_word", keyword_blocks("w_", "messages", "compile error", "name_stats", SPACES),
       "SELECT * FROM w_keywords")


def excerpt_blocks(prefix: str, bodies: str, opening: str, closing: str) -> str:
    """Blocks for the excerpts of (id, body) rows; the last one is `<prefix>excerpts`."""
    for name, mark in (("opens", opening), ("closes", closing)):
        block(f"{prefix}{name}", bodies, f"""SELECT id, i - 1 k, pos FROM (SELECT id, i, n,
            (sum(length(part) + {len(mark)}) OVER (PARTITION BY id ORDER BY i) - {len(mark)})::BIGINT pos
            FROM (SELECT id, unnest(parts) part, generate_subscripts(parts, 1) i, len(parts) n
                  FROM (SELECT id, string_split(body, '{mark}') parts FROM {bodies}))) WHERE i < n""")
    block(f"{prefix}pairs", f"{prefix}opens {prefix}closes", f"""SELECT o.id, o.k, o.pos opened, coalesce(c.pos, -1) closed
        FROM {prefix}opens o LEFT JOIN (SELECT id, count(*) n FROM {prefix}closes GROUP BY id) e USING (id)
        LEFT JOIN {prefix}closes c ON c.id = o.id AND c.k = o.k % (coalesce(e.n, 0) + 1)""")
    block(f"{prefix}cuts", f"{prefix}pairs", f"""SELECT id, arg_max(cut, k) cut FROM (SELECT id, k,
        CASE WHEN abs(closed - 300) < 100 THEN closed WHEN abs(opened - 300) < 100 THEN opened - 1
             WHEN opened < 300 AND closed > 300 THEN opened - 1 END cut FROM {prefix}pairs) WHERE cut IS NOT NULL GROUP BY id""")
    block(f"{prefix}excerpts", f"{prefix}cuts", f"""SELECT id, substring(body, 1, upto) excerpt, length(body) > upto has_more
        FROM (SELECT id, body, greatest(coalesce(cut, 300), 0) upto FROM {bodies} LEFT JOIN {prefix}cuts USING (id))""")
    return f"{prefix}excerpts"


block("page_bodies", "", "SELECT page_id id, html body FROM pages")
oracle("excerpt_posts", excerpt_blocks("p_", "page_bodies", "<p>", "</p>"),
       "SELECT id page_id, excerpt, has_more FROM p_excerpts")
oracle("hash_tags", "", f"""SELECT p_partkey, array_to_string([{code('tag')} FOR tag IN string_split(p_name, ' ')], ',') hashes,
    {code('p_brand')} code FROM part""")

# aggregations

oracle("term_stats", "doc_stats", f"SELECT {ROUNDED} FROM doc_stats")
oracle("tag_stats", "some_tag_stats", f"SELECT {ROUNDED} FROM some_tag_stats")
oracle("corpus_totals", "doc_tokens",
       "SELECT (SELECT count(*) FROM doc_tokens) term_count, (SELECT count(*) FROM documents) doc_count")
oracle("term_frequency", "", r"""SELECT doc_id, term, count(*) frequency FROM (SELECT doc_id,
    unnest(regexp_extract_all(text, '[\p{L}\p{Nd}_]+')) term FROM documents)
    WHERE regexp_full_match(term, '[A-Z][A-Za-z0-9_]+') GROUP BY ALL""")
block("exact_tokens", "", f"SELECT unnest(regexp_extract_all(text, {WORDS})) term FROM documents")
oracle("occurrence_idf", "doc_tokens exact_tokens", """SELECT term, coalesce(c, 0) occurrences,
    CASE WHEN n // c = 0 THEN '-inf'::DOUBLE ELSE round(ln((n // c)::DOUBLE), 6) END idf
    FROM (SELECT DISTINCT term, (SELECT count(*) FROM documents) n FROM doc_tokens)
    LEFT JOIN (SELECT term, count(*) c FROM exact_tokens GROUP BY term) USING (term)""")
# a tile between two marks, so that a term's tiles stand together in a text's only where they are its own
MARKED = "array_to_string(list_transform({}, lambda x: chr(2) || x || chr(3)), '')"
block("phrases", "", f"""SELECT DISTINCT array_to_string(own, '') term, {MARKED.format("own")} marked FROM (
    SELECT unnest([tiles[1:3], tiles[3:4], tiles[4:5], tiles[7:11]]) own FROM (
      SELECT regexp_extract_all(text, {PIECES}, 1) tiles FROM benchmark)) WHERE own <> []""")
block("marked_texts", "", f"""SELECT {MARKED.format("regexp_extract_all(inside, " + PIECES + ", 1)")} marked FROM (
    SELECT regexp_replace(regexp_replace(text, '^[^\\p{{L}}\\p{{Nd}}_]+', ''), '[^\\p{{L}}\\p{{Nd}}_]+$', '') inside FROM documents)""")
oracle("occurrence_idf_phrases", "phrases marked_texts", """SELECT term, c::BIGINT occurrences,
      CASE WHEN c = 0 THEN NULL WHEN n // c = 0 THEN '-inf'::DOUBLE ELSE round(ln((n // c)::DOUBLE), 6) END idf
    FROM (SELECT term, (SELECT count(*) FROM documents) n,
        sum((length(t.marked) - length(replace(t.marked, p.marked, ''))) // length(p.marked)) c
      FROM phrases p, marked_texts t GROUP BY term)""")
block("weighted", "context_terms", "SELECT context_id, term, sum(weight)::BIGINT weight FROM context_terms GROUP BY ALL")
oracle("weighted_terms", "weighted", "SELECT * FROM weighted")
block("part_clicks", "tagged_parts", """SELECT o_custkey user_id, tags,
    CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END weight
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN tagged_parts ON l_partkey = post_id""")
block("part_profile", "part_clicks", """SELECT user_id, tag, sum(weight)::BIGINT clicks
    FROM (SELECT user_id, unnest(tags) tag, weight FROM part_clicks) GROUP BY ALL""")
oracle("tag_profile", "part_profile", "SELECT * FROM part_profile")
block("actions", "", """SELECT user_id, event_id seq,
    CASE WHEN event_type = 'click' THEN 'add' WHEN event_type = 'view' THEN 'expand' WHEN event_type = 'purchase' THEN 'browser'
         WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'clear' WHEN event_type = 'signup' AND event_id % 4 = 1 THEN 'replay'
         WHEN event_type = 'signup' THEN 'contract' ELSE 'remove' END AS "action",
    CASE WHEN event_type IN ('click', 'error') THEN 't' || event_id % 3 ELSE 't0,t' || (event_id % 2 + 1) END tags FROM events""")
# the selection after each action, as the user's tag box would hold it
block("numbered", "actions", "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) rn FROM actions")
block("selection", "numbered", """
    SELECT DISTINCT user_id, 0::BIGINT rn, []::VARCHAR[] held, FALSE counted FROM actions
    UNION ALL
    SELECT s.user_id, s.rn + 1, CASE a."action" WHEN 'clear' THEN []::VARCHAR[] WHEN 'replay' THEN string_split(tags, ',')
        WHEN 'add' THEN CASE WHEN list_contains(held, tags) THEN held ELSE list_append(held, tags) END
        WHEN 'remove' THEN list_filter(held, lambda x: x <> tags) ELSE held END,
      a."action" = 'add' AND NOT list_contains(held, tags)
    FROM selection s JOIN numbered a ON a.user_id = s.user_id AND a.rn = s.rn + 1""")
for name in ("tag_profile_from_actions", "tag_profile_stream"):
    oracle(name, "selection", """SELECT user_id, tag, sum(w)::BIGINT clicks FROM (
    SELECT user_id, unnest(string_split(tags, ',')) tag,
      CASE WHEN counted THEN 2 WHEN "action" = 'expand' THEN 1 WHEN "action" = 'browser' THEN 3 ELSE 0 END w
    FROM numbered JOIN selection USING (user_id, rn)) WHERE w > 0 GROUP BY ALL""")
block("console", "", """SELECT user_id console_id, user_id, event_id seq,
    CASE WHEN event_type IN ('purchase', 'view') THEN 'SYSTEM' WHEN event_type = 'error' THEN 'ERROR_OUTPUT' ELSE 'NORMAL' END content_type,
    CASE event_type WHEN 'purchase' THEN chr(10) || 'Process finished with exit code 1' || chr(10)
      WHEN 'error' THEN 'java.lang.IllegalStateException: ' || props || chr(10) || 'at jdk 1.' || (user_id % 9 + 1)
                        || CASE WHEN event_id % 2 = 0 THEN chr(10) ELSE '' END
      ELSE 'java 1.' || (event_id % 9 + 1) END chunk FROM events""")


oracle("console_stream", "console", "SELECT console_id, user_id, seq, content_type, chunk FROM console")


def run_blocks(prefix: str, console: str) -> str:
    """Blocks for the texts of finished failed runs; the last one is `<prefix>texts`."""
    block(f"{prefix}chunks", console, rf"""SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY console_id ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT run FROM (SELECT *, content_type = 'SYSTEM'
        AND regexp_full_match(chunk, '\nProcess finished with exit code \d+\n') is_end,
        CASE content_type WHEN 'ERROR_OUTPUT' THEN 'ERROR' WHEN 'SYSTEM' THEN 'INFORMATION' END category FROM {console})""")
    block(f"{prefix}texts", f"{prefix}chunks", f"""SELECT console_id, run, category, string_agg(chunk, '' ORDER BY seq) AS text
        FROM {prefix}chunks WHERE NOT is_end AND category IS NOT NULL AND (console_id, run) IN
          (SELECT (console_id, run) FROM {prefix}chunks GROUP BY console_id, run
           HAVING bool_or(is_end) AND bool_or(category = 'ERROR')) GROUP BY ALL""")
    return f"{prefix}texts"


oracle("console_runs", run_blocks("r_", "console"), "SELECT console_id, run, category, 0 part, text FROM r_texts")
for name in ("runtime_error_stream", "silent_console_runs"):
    oracle(name, "r_texts", """SELECT console_id, run, category, unnest(lines) AS text,
    generate_subscripts(lines, 1) - 1 line_no FROM (SELECT *, string_split(text, chr(10)) lines FROM r_texts)""")
for name, size in (("group_messages", 10_000), ("group_messages_in_parts", 3)):
    oracle(name, "messages", f"""SELECT run_id, (pos // {size})::INT part,
    coalesce(string_agg(text, '|' ORDER BY pos) FILTER (category = 'ERROR'), '') errors,
    coalesce(string_agg(text, '|' ORDER BY pos) FILTER (category = 'WARNING'), '') warnings,
    coalesce(string_agg(text, '|' ORDER BY pos) FILTER (category = 'INFORMATION'), '') informations
    FROM messages GROUP BY ALL""")

# joins

SCQ = "(1 + log10(ctf::DOUBLE)) * idf"
VAR = f"{SCQ} / (SELECT count(*) FROM documents)"
block("term_scores", "context_terms doc_stats", f"""SELECT term, coalesce({SCQ}, 0) scq, coalesce({VAR}, 0) var,
    coalesce(ictf, 0) ictf, coalesce(idf, 0) idf, ctf IS NOT NULL known,
    coalesce({SCQ}, 0) + coalesce({VAR}, 0) + coalesce(ictf, 0) + coalesce(idf, 0) score
    FROM (SELECT DISTINCT term FROM context_terms) LEFT JOIN doc_stats USING (term)""")
for scorer in ("ictf", "idf", "scq", "var"):
    oracle(f"score_{scorer}", "term_scores", f"SELECT term, round({scorer}, 6) {scorer} FROM term_scores")
oracle("combine_scores", "term_scores", """SELECT term, round(scq, 6) scq, round(var, 6) var, round(ictf, 6) ictf,
    round(idf, 6) idf, round(score, 6) score FROM term_scores""")
block("results", "tagged_parts", """SELECT l_orderkey request_id, o_custkey user_id, l_partkey post_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 position, tags
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN tagged_parts ON l_partkey = post_id""")


def rank_blocks(prefix: str, results: str, profile: str, stats: str) -> str:
    """Blocks for the personal ranks of listed posts; the last one is `<prefix>final`."""
    block(f"{prefix}scores", f"{results} {profile} {stats}", f"""SELECT request_id, user_id, post_id, position,
        coalesce(sum(idf * (1 + log10(clicks::DOUBLE))), 0) / greatest(len(any_value(tags)), 1) score
        FROM (SELECT *, unnest(CASE WHEN tags = [] THEN [NULL] ELSE tags END) tag FROM {results}) r LEFT JOIN {profile} p USING (user_id, tag)
        LEFT JOIN {stats} s ON s.term = p.tag GROUP BY ALL""")
    block(f"{prefix}weighted", f"{prefix}scores", f"""SELECT *, position initial_rank, row_number() OVER
        (PARTITION BY request_id ORDER BY round(score, 9) DESC, position) - 1 weighted_rank FROM {prefix}scores""")
    block(f"{prefix}final", f"{prefix}weighted", f"""SELECT *, row_number() OVER (PARTITION BY request_id
        ORDER BY (initial_rank + weighted_rank) // 2, weighted_rank) - 1 final_rank FROM {prefix}weighted""")
    return f"{prefix}final"


rank_blocks("l_", "results", "part_profile", "tag_stats")
oracle("score_posts_for_user", "l_scores",
       "SELECT request_id, user_id, post_id, position, round(score, 6) score FROM l_scores")
oracle("initial_rank", "", """SELECT l_orderkey request_id, l_linenumber, l_partkey, l_suppkey,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 initial_rank FROM lineitem""")
oracle("weighted_rank", "l_weighted", "SELECT request_id, post_id, position, weighted_rank FROM l_weighted")
oracle("final_rank", "l_final", """SELECT request_id, user_id, post_id, position, round(score, 6) score, initial_rank,
    weighted_rank, final_rank FROM l_final""")

block("posts", "", f"""SELECT doc_id post_id, 'doc ' || doc_id title, text body, [lang, source] tags, (doc_id % 10)::INT votes,
    doc_id created, doc_id * 7 % 1000 active, regexp_extract_all(lower('doc ' || doc_id || chr(10) || text),
    {WORDS}) post_terms FROM documents""")


def index_blocks(prefix: str, posts: str) -> None:
    """Blocks `<prefix>postings` with counts, and `<prefix>terms` with idf."""
    block(f"{prefix}postings", posts, f"""SELECT post_id, any_value(tags) post_tags, term, count(*) tf
        FROM (SELECT post_id, tags, unnest(post_terms) term FROM {posts}) GROUP BY post_id, term""")
    block(f"{prefix}terms", f"{prefix}postings", f"""SELECT term, ln((SELECT count(*) FROM {posts})::DOUBLE / count(*)) idf
        FROM {prefix}postings GROUP BY term""")


index_blocks("doc_", "posts")


def match_blocks(prefix: str, queries: str, posts: str, postings: str, stats: str) -> str:
    """Blocks for the matches of (request_id, step, q, tags); the last one is `<prefix>matches`."""
    words = f"list_distinct(regexp_extract_all(lower(replace(replace(q, '{{', ''), '}}', '')), {WORDS}))"
    block(f"{prefix}asked", queries, f"SELECT request_id, step, tags, {words} terms FROM {queries}")
    block(f"{prefix}matches", f"{prefix}asked {posts} {postings} {stats}", f"""
        SELECT a.request_id, a.step, p.post_id, sum((1 + ln(p.tf)) * s.idf) relevance
        FROM (SELECT *, unnest(terms) term FROM {prefix}asked) a
        JOIN {postings} p ON p.term = a.term AND list_has_all(p.post_tags, a.tags) JOIN {stats} s ON s.term = a.term
        GROUP BY a.request_id, a.step, p.post_id, len(a.terms) HAVING count(*) = len(a.terms)
        UNION ALL SELECT request_id, step, post_id, 0 FROM {prefix}asked a JOIN {posts} p ON list_has_all(p.tags, a.tags)
        WHERE a.terms = [] AND a.tags <> []""")
    return f"{prefix}matches"


block("whole", "ready", "SELECT request_id, 0 step, clean_q q, tags FROM ready")
oracle("match_posts", match_blocks("m_", "whole", "posts", "doc_postings", "doc_terms"),
       "SELECT request_id, post_id, round(relevance, 6) relevance FROM m_matches")
block("page_sizes", "ready", "SELECT request_id, user_id % 3 AS page, user_id % 5 + 2 AS size FROM ready")


def page_of(matches: str, columns: str) -> str:
    return f"""SELECT {columns}, position, post_id, round(relevance, 6) relevance, found > (page + 1) * size has_more FROM (
        SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(relevance, 9) DESC, post_id) - 1 AS position,
          count(*) OVER (PARTITION BY request_id) found FROM {matches} JOIN page_sizes USING (request_id))
      WHERE position BETWEEN page * size AND (page + 1) * size - 1"""


oracle("match_posts_page", "m_matches page_sizes", page_of("m_matches", "request_id"))
block("name_words", "", """SELECT p_partkey, unnest(ws) word, generate_subscripts(ws, 1) i FROM (SELECT p_partkey,
    string_split(lower(p_type || ' ' || p_name || ' ' || p_brand || ' ' || p_name), ' ') ws FROM part)""")
oracle("keep_vocabulary", "name_words name_stats", """SELECT p_partkey, coalesce(string_agg(word, '|' ORDER BY i)
    FILTER (word IN (SELECT term FROM name_stats)), '') words FROM name_words GROUP BY p_partkey""")


def backoff_blocks(prefix: str, requests: str, posts: str, postings: str, stats: str) -> str:
    """Blocks for (request_id, q, tags, backoff) rows; the last one is `<prefix>found`."""
    block(f"{prefix}cut", requests, rf"""SELECT request_id, q, tags, backoff,
        string_split_regex(regexp_replace(q, '\s+$', ''), '\s') ws FROM {requests}""")
    block(f"{prefix}steps", f"{prefix}cut", f"""SELECT request_id, step, last, tags,
        CASE WHEN step = 0 THEN q ELSE array_to_string(ws[step + 1:], ' ') END q
        FROM (SELECT *, CASE WHEN backoff THEN greatest(len(ws) - 1, 0) ELSE 0 END last, unnest(range(last + 1)) step FROM {prefix}cut)""")
    match_blocks(prefix, f"{prefix}steps", posts, postings, stats)
    block(f"{prefix}found", f"{prefix}matches", f"""SELECT s.request_id, s.q query, m.post_id, m.relevance
        FROM {prefix}steps s LEFT JOIN (SELECT request_id, min(step) hit FROM {prefix}matches GROUP BY 1) h USING (request_id)
        LEFT JOIN {prefix}matches m ON m.request_id = s.request_id AND m.step = s.step WHERE s.step = coalesce(hit, last)""")
    return f"{prefix}found"


block("all_backing", "ready", "SELECT request_id, clean_q q, tags, TRUE backoff FROM ready")
oracle("search_with_backoff", backoff_blocks("b_", "all_backing", "posts", "doc_postings", "doc_terms"),
       "SELECT request_id, query, post_id, round(relevance, 6) relevance FROM b_found")
oracle("search_with_backoff_page", "b_found page_sizes", page_of("(SELECT * FROM b_found WHERE post_id IS NOT NULL)", "request_id, query"))
block("error_lines", "ready", r"""SELECT request_id, clean_q q, []::VARCHAR[] tags, 0 step, string_split_regex(
    trim(replace(replace(clean_q, '{', ''), '}', ''), ' '), '\s')[-1] last_word FROM ready""")
match_blocks("e_", "error_lines", "posts", "doc_postings", "doc_terms")
block("error_words", "error_lines", "SELECT request_id, last_word q, tags, 0 step FROM error_lines")
match_blocks("f_", "error_words", "posts", "doc_postings", "doc_terms")
oracle("error_search", "e_matches f_matches", """
    SELECT request_id run_id, q query, post_id, round(relevance, 6) relevance FROM error_lines JOIN e_matches USING (request_id)
    UNION ALL SELECT request_id, last_word, post_id, round(relevance, 6) FROM error_lines LEFT JOIN f_matches USING (request_id)
    WHERE request_id NOT IN (SELECT request_id FROM e_matches)""")

# ranks and windows

block("auto", "context_terms term_scores contexts", """SELECT context_id, coalesce(string_agg(term, ' ' ORDER BY place), '') query
    FROM contexts LEFT JOIN (SELECT context_id, term, row_number() OVER (PARTITION BY context_id ORDER BY score DESC, term) place
      FROM (SELECT DISTINCT context_id, term FROM context_terms) JOIN term_scores USING (term)) t
    USING (context_id) WHERE place <= 4 OR place IS NULL GROUP BY context_id""")
oracle("auto_query", "auto", "SELECT * FROM auto")
oracle("top_terms", "weighted term_scores contexts", """SELECT context_id, coalesce(string_agg(term, ' ' ORDER BY place), '') query
    FROM contexts LEFT JOIN (SELECT context_id, term, row_number() OVER (PARTITION BY context_id ORDER BY score * weight DESC, term) place
      FROM weighted JOIN term_scores USING (term) WHERE known) t
    USING (context_id) WHERE place <= 3 OR place IS NULL GROUP BY context_id""")
oracle("event_mix", "editor", """SELECT user_id, ts, event_id, kind, inserts, deletes,
      round(ratio, 6) delete_ratio, round(share, 6) edit_share, ratio >= 0.6::DOUBLE OR share < 0.6::DOUBLE hard
    FROM (SELECT *, CASE WHEN inserts = 0 THEN 0 ELSE deletes::DOUBLE / (deletes + inserts) END ratio,
        inserts / 24::DOUBLE + deletes / 24::DOUBLE share
      FROM (SELECT *, count(*) FILTER (kind = 'Insert') OVER w inserts, count(*) FILTER (kind = 'Delete') OVER w deletes,
          row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) n FROM editor
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)) WHERE n >= 26)""")
# the history as the user's list would hold it, entry by entry
block("kept_searches", "searches", """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) rn FROM searches WHERE NOT replay""")
block("history", "kept_searches", """
    SELECT DISTINCT user_id, 0::BIGINT rn, []::STRUCT(query VARCHAR, tags VARCHAR)[] entries FROM kept_searches
    UNION ALL
    SELECT h.user_id, h.rn + 1, CASE
        WHEN manual AND len(entries) > 0 AND entries[-1].query = s.query
          THEN list_append(entries[:-2], {'query': s.query, 'tags': s.tags})
        WHEN manual AND s.query = '' AND s.tags = '' THEN entries
        ELSE list_append(entries, {'query': s.query, 'tags': s.tags}) END
    FROM history h JOIN kept_searches s ON s.user_id = h.user_id AND s.rn = h.rn + 1""")
oracle("query_history", "history", """SELECT user_id, i - 1 entry, n - i "index", e.query, e.tags FROM (
    SELECT user_id, unnest(entries) e, generate_subscripts(entries, 1) i, len(entries) n FROM history
    WHERE (user_id, rn) IN (SELECT (user_id, max(rn)) FROM history GROUP BY user_id))""")
oracle("sort_posts", "parts", """SELECT "user" request_id, post_id, votes,
    row_number() OVER (PARTITION BY "user" ORDER BY votes DESC, post_id) - 1 position FROM parts""")
oracle("sort_posts_by_activity", "parts", """SELECT "user" request_id, post_id,
    row_number() OVER (PARTITION BY "user" ORDER BY active DESC, post_id) - 1 position FROM parts""")

# state machines, one event at a time

block("fast_numbered", "editor_fast", """SELECT user_id, event_id, ts // 1000 ms, kind,
    row_number() OVER (PARTITION BY user_id ORDER BY ts // 1000, event_id) rn FROM editor_fast""")
block("kept", "fast_numbered", """
    SELECT DISTINCT user_id, 0::BIGINT rn, NULL::BIGINT last_ms, NULL::VARCHAR last_kind, FALSE accepted FROM fast_numbered
    UNION ALL
    SELECT user_id, rn + 1, CASE WHEN again THEN last_ms ELSE ms END, CASE WHEN again THEN last_kind ELSE kind END, NOT again
    FROM (SELECT k.*, e.ms, e.kind, coalesce(e.kind = last_kind AND e.ms - last_ms < 1000, FALSE) again
          FROM kept k JOIN fast_numbered e ON e.user_id = k.user_id AND e.rn = k.rn + 1)""")
oracle("debounce", "kept", """SELECT user_id, event_id, kind, ms * 1000 ts FROM kept JOIN fast_numbered USING (user_id, rn)
    WHERE accepted""")


def machine_blocks(prefix: str, events: str) -> str:
    """Blocks for the difficulty machine over (user_id, event_id, ts in microseconds, kind).

    `<prefix>machine` has the state after every event and the lines it logged, `<prefix>log` the
    lines and `<prefix>fired` the events that set off a query.
    """
    block(f"{prefix}in", events, f"""SELECT user_id, event_id, ts // 1000 ms, kind,
        row_number() OVER (PARTITION BY user_id ORDER BY ts // 1000, event_id) rn FROM {events}""")
    kinds = {"cs": "Scroll", "cc": "Click", "ci": "Insert", "cd": "Delete"}
    line = "STRUCT(ms BIGINT, event_id BIGINT, event VARCHAR, state VARCHAR)"

    def log(when: str, ms: str, event_id: str, event: str, state: str) -> str:
        return f"""CASE WHEN {when} THEN [{{'ms': {ms}, 'event_id': {event_id}, 'event': '{event}', 'state': {state}}}]
            ELSE [] END"""

    step = f"""SELECT m.user_id, m.rn + 1 rn, m.mode, q, tail_ms, tail_kind, cs, cc, ci, cd, resume, idle,
        e.ms, e.event_id, e.kind, m.mode = 'query' AND e.ms >= resume woke,
        coalesce(m.mode = 'collect' AND e.ms >= idle, FALSE) paused
        FROM {prefix}machine m JOIN {prefix}in e ON e.user_id = m.user_id AND e.rn = m.rn + 1"""
    step = f"""SELECT *, CASE WHEN woke THEN 'collect' WHEN paused THEN 'pause' ELSE mode END now,
        coalesce(tail_kind = kind AND ms - tail_ms < 1000, FALSE) again FROM ({step})"""
    step = f"SELECT *, NOT again AND now <> 'query' taken, NOT again AND now <> 'query' AND len(q) = 25 popped FROM ({step})"
    counted = ", ".join(
        f"CASE WHEN taken AND kind = '{k}' THEN coalesce({c}, 0) + 1 ELSE {c} END {c}1" for c, k in kinds.items()
    )
    step = f"SELECT *, {counted} FROM ({step})"
    lowered = ", ".join(
        f"CASE WHEN popped AND q[1] = '{k}' THEN coalesce({c}1, 1) - 1 ELSE {c}1 END {c}2" for c, k in kinds.items()
    )
    step = f"SELECT *, {lowered} FROM ({step})"
    step = f"""SELECT *, popped AND coalesce(ci2, 0) <> 0 AND CASE WHEN coalesce(ci2, 0) + coalesce(cd2, 0) = 0
        THEN coalesce(cd2, 0) > 0 ELSE coalesce(cd2, 0)::DOUBLE / (ci2 + coalesce(cd2, 0)) >= 0.6::DOUBLE END by_deletes,
        popped AND coalesce(ci2, 0) / 24::DOUBLE + coalesce(cd2, 0) / 24::DOUBLE < 0.6::DOUBLE by_others FROM ({step})"""
    step = f"SELECT *, by_deletes OR by_others fired FROM ({step})"
    lines = " || ".join([
        log("woke", "resume", "NULL::BIGINT", "transition", "'collect'"),
        log("paused", "idle", "NULL::BIGINT", "transition", "'pause'"),
        log("taken AND now = 'pause'", "ms", "event_id", "transition", "'collect'"),
        log("by_deletes", "ms", "event_id", "DeleteRatioAutoQuery", "NULL::VARCHAR"),
        log("by_others", "ms", "event_id", "NonEditRatioAutoQuery", "NULL::VARCHAR"),
        log("fired", "ms", "event_id", "transition", "'query'"),
    ])
    after = ", ".join(f"CASE WHEN fired THEN NULL ELSE {c}2 END" for c in kinds)
    seen = ", ".join(f"coalesce({c}2, 0)" for c in kinds)
    block(f"{prefix}machine", f"{prefix}in", f"""
        SELECT DISTINCT user_id, 0::BIGINT rn, 'collect' AS "mode", []::VARCHAR[] q, NULL::BIGINT tail_ms, NULL::VARCHAR tail_kind,
          NULL::INT cs, NULL::INT cc, NULL::INT ci, NULL::INT cd, NULL::BIGINT resume, NULL::BIGINT idle,
          []::{line}[] lines, FALSE fired, 0 ns, 0 nc, 0 ni, 0 nd FROM {prefix}in
        UNION ALL
        SELECT user_id, rn, CASE WHEN NOT taken THEN now WHEN fired THEN 'query' ELSE 'collect' END,
          CASE WHEN NOT taken THEN q WHEN fired THEN [kind] WHEN popped THEN list_append(q[2:], kind) ELSE list_append(q, kind) END,
          CASE WHEN taken THEN ms ELSE tail_ms END, CASE WHEN taken THEN kind ELSE tail_kind END, {after},
          CASE WHEN fired THEN ms + 30000 WHEN woke THEN NULL ELSE resume END,
          CASE WHEN fired THEN NULL WHEN taken THEN ms + 900000 WHEN paused THEN NULL ELSE idle END,
          {lines}, fired, {seen} FROM ({step})""")
    block(f"{prefix}log", f"{prefix}machine", f"""SELECT user_id, l.ms * 1000 ts, l.event_id event_id, l.event event, l.state state,
        CASE WHEN l.event <> 'transition' THEN ns END::INT scroll, CASE WHEN l.event <> 'transition' THEN nc END::INT click,
        CASE WHEN l.event <> 'transition' THEN ni END::INT AS "insert", CASE WHEN l.event <> 'transition' THEN nd END::INT AS "delete"
        FROM (SELECT user_id, unnest(lines) l, ns, nc, ni, nd FROM {prefix}machine WHERE rn > 0)""")
    block(f"{prefix}fired", f"{prefix}machine",
          f"SELECT user_id, i.ms, i.event_id FROM {prefix}machine m JOIN {prefix}in i USING (user_id, rn) WHERE fired")
    return f"{prefix}log"


oracle("detect_difficulty", machine_blocks("d_", "editor"), "SELECT * FROM d_log")
oracle("detect_difficulty_fast", machine_blocks("s_", "editor_fast"), "SELECT * FROM s_log")
oracle("detect_difficulty_stream", "d_log", """SELECT * FROM d_log UNION ALL
    SELECT user_id, due * 1000, NULL, 'transition', CASE "mode" WHEN 'query' THEN 'collect' ELSE 'pause' END, NULL, NULL, NULL, NULL
    FROM (SELECT *, CASE "mode" WHEN 'query' THEN resume ELSE idle END due FROM d_machine
          WHERE (user_id, rn) IN (SELECT (user_id, max(rn)) FROM d_machine GROUP BY user_id))
    WHERE "mode" <> 'pause' AND due <= (SELECT max(ms) FROM d_in)""")
oracle("inactivity_pause", "editor_slow", """SELECT user_id, (last // 1000 + 900000) * 1000 paused, ts resumed FROM (
    SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) last FROM editor_slow)
    WHERE ts // 1000 >= last // 1000 + 900000""")
oracle("cool_down", "s_fired", """SELECT user_id, event_id, ts, kind FROM editor_fast e WHERE NOT EXISTS (
    SELECT 1 FROM s_fired f WHERE f.user_id = e.user_id AND (f.ms < e.ts // 1000 OR f.ms = e.ts // 1000 AND f.event_id < e.event_id)
      AND e.ts // 1000 < f.ms + 30000)""")
block("event_contexts", "sources", """SELECT user_id, event_id, text, (event_id % 4)::INT caret_line, NULL::VARCHAR selected
    FROM events JOIN sources ON file_id = event_id % (SELECT count(*) FROM part)""")
block("stuck", "d_fired event_contexts generous visible", f"""SELECT user_id || ':' || event_id context_id, user_id, event_id, text,
    caret_line, selected FROM (SELECT DISTINCT user_id, event_id FROM d_fired) JOIN event_contexts USING (user_id, event_id)
    WHERE user_id IN (SELECT user_id FROM visible) AND {gate('difficulty', 'generous')}""")
oracle("difficulty_queries", "stuck", "SELECT * FROM stuck")

oracle("difficulty_queries_as_of", "d_fired editor event_contexts setting_changes window_changes", f"""
    SELECT user_id || ':' || event_id context_id, user_id, event_id, text, caret_line, selected
    FROM (SELECT DISTINCT e.user_id, e.event_id, e.ts FROM d_fired JOIN editor e USING (user_id, event_id)) t
    JOIN event_contexts USING (user_id, event_id)
    WHERE {as_of('visible', 'window_changes', 'FALSE', 't')} AND {as_of('auto_query AND difficulty', 'setting_changes', 'TRUE', 't')}""")

# telemetry

oracle("query_events", "query_events", "SELECT user_id, seq, QueryEventType, Tags, sort, Visible FROM query_events")
oracle("result_events", "searches", """SELECT user_id, seq, ['expand', 'contract', 'browser'][seq % 3 + 1] ResultEventType,
    coalesce((SELECT arg_max(query_type, q.seq) FROM searches q JOIN events v ON v.event_id = q.seq
              WHERE q.user_id = c.user_id AND q.seq < c.seq AND v.event_type <> 'click'), '-1') SourceQuery,
    (seq % 10)::INT AS "Index", 10 Total FROM (SELECT user_id, event_id seq FROM events WHERE event_type = 'click') c""")
oracle("difficulty_events", "d_log generous visible", f"""SELECT user_id, ts, event_id, event DifficultyEventType, state "State",
    scroll, click, "insert", "delete" FROM d_log WHERE event = 'transition'
    OR user_id IN (SELECT user_id FROM visible) AND {gate('difficulty', 'generous')}""")
oracle("settings_events", "settings", """SELECT user_id, 'Changed' SettingsEventType, auto_query::VARCHAR AUTO_QUERY,
    runtime_error::VARCHAR RUNTIME_ERROR, compile_error::VARCHAR COMPILE_ERROR, difficulty::VARCHAR DIFFICULTY,
    logging::VARCHAR LOGGING FROM settings""")

# jobs

block("gated_messages", "messages settings", f"""SELECT * FROM messages WHERE {gate('compile_error')}
    AND run_id IN (SELECT run_id FROM messages WHERE category = 'ERROR')""")
keyword_blocks("j_", "gated_messages", "compile error", "name_stats", LINES)
oracle("compile_error_queries", "j_keywords", """SELECT run_id, keywords, replace(string_split(
    (SELECT arg_min(text, pos) FROM gated_messages g WHERE g.run_id = k.run_id AND category = 'ERROR'), chr(10))[1], ':', '') first_line
    FROM j_keywords k""")
block("gated_console", "console generous", f"SELECT * FROM console WHERE {gate('runtime_error', 'generous')}")
run_blocks("g_", "gated_console")
block("run_messages", "g_texts", "SELECT console_id || ':' || run run_id, category, 0 pos, text FROM g_texts")
keyword_blocks("k_", "run_messages", "runtime error", "name_stats", LINES)
oracle("runtime_error_queries", "k_keywords", """SELECT run_id, keywords, replace(string_split(text, chr(10))[1], ':', '') first_line
    FROM k_keywords JOIN run_messages USING (run_id) WHERE category = 'ERROR'""")

block("doc_profile", "", """SELECT user_id, tag, sum(w)::BIGINT clicks FROM (SELECT user_id % 40 user_id,
    CASE event_type WHEN 'click' THEN 3 ELSE 1 END w,
    unnest(CASE event_type WHEN 'view' THEN ['en', 'src' || event_id % 7] ELSE ['src' || event_id % 5] END) tag FROM events) GROUP BY ALL""")
block("doc_tag_tokens", "", "SELECT doc_id, unnest([lang, source]) term FROM documents")
block("doc_tag_stats", "doc_tag_tokens", stats_of("doc_tag_tokens", "documents"))


def ranked_blocks(prefix: str, found: str, requests: str, posts: str, profile: str, tags: str, marks: tuple) -> str:
    """Blocks for what requests have found, ranked and excerpted; the last one is `<prefix>ranked`."""
    block(f"{prefix}listed", f"{found} {requests} {posts}", f"""SELECT f.request_id, f.query, f.post_id, r.user_id, r.sort, p.tags, p.title,
        row_number() OVER (PARTITION BY f.request_id ORDER BY CASE r.sort WHEN 'votes' THEN p.votes WHEN 'newest' THEN p.created
          WHEN 'active' THEN p.active ELSE round(f.relevance, 9) END DESC, f.post_id) - 1 position
        FROM {found} f JOIN {requests} r USING (request_id) JOIN {posts} p USING (post_id)""")
    block(f"{prefix}personal", f"{prefix}listed",
          f"SELECT request_id, user_id, post_id, position, tags FROM {prefix}listed WHERE sort = 'relevance'")
    rank_blocks(prefix, f"{prefix}personal", profile, tags)
    block(f"{prefix}bodies", posts, f"SELECT post_id id, body FROM {posts}")
    excerpt_blocks(prefix, f"{prefix}bodies", *marks)
    block(f"{prefix}ranked", f"{prefix}listed {prefix}final {prefix}excerpts", f"""SELECT l.request_id, query, sort,
        coalesce(final_rank, l.position) final_rank, l.position initial_rank, round(score, 6) score, l.post_id, title, excerpt, has_more
        FROM {prefix}listed l JOIN {prefix}excerpts x ON x.id = l.post_id
        LEFT JOIN {prefix}final f ON f.request_id = l.request_id AND f.post_id = l.post_id""")
    return f"{prefix}ranked"


def search_blocks(prefix: str, requests: str, posts: str, postings: str, stats: str, profile: str, tags: str, marks: tuple) -> str:
    """The same for requests that back off."""
    found = backoff_blocks(prefix, f"{prefix}requests", posts, postings, stats)
    return ranked_blocks(prefix, found, requests, posts, profile, tags, marks)


block("x_requests", "ready", "SELECT request_id, clean_q q, tags, backoff FROM ready")
oracle("personalised_search",
       search_blocks("x_", "ready", "posts", "doc_postings", "doc_terms", "doc_profile", "doc_tag_stats", ("the", "and")),
       "SELECT * FROM x_ranked")

block("error_posts", "parts", f"""SELECT post_id, title, body, tags, votes, created, active,
      regexp_extract_all(lower(title || chr(10) || body), {WORDS}) post_terms
    FROM (SELECT * REPLACE ('Compile error, runtime error: IOException IllegalStateException, java ' || (votes % 9 + 1)
      || coalesce('; ' || body, '') AS body, coalesce(tags, []::VARCHAR[]) AS tags) FROM parts)""")
index_blocks("err_", "error_posts")


def error_blocks(prefix: str, errors: str) -> str:
    """Blocks for the ranked results of (run_id, user_id, first_line, keywords); the last one is `<prefix>ranked`."""
    block(f"{prefix}shown", f"{errors} visible", f"""SELECT run_id request_id, user_id, 'relevance' sort, first_line, keywords
        FROM {errors} WHERE user_id IN (SELECT user_id FROM visible)""")
    block(f"{prefix}lines", f"{prefix}shown", f"SELECT request_id, 0 step, first_line q, []::VARCHAR[] tags FROM {prefix}shown")
    match_blocks(f"{prefix}l", f"{prefix}lines", "error_posts", "err_postings", "err_terms")
    block(f"{prefix}words", f"{prefix}shown", f"SELECT request_id, 0 step, keywords q, []::VARCHAR[] tags FROM {prefix}shown")
    match_blocks(f"{prefix}w", f"{prefix}words", "error_posts", "err_postings", "err_terms")
    block(f"{prefix}found", f"{prefix}lmatches {prefix}wmatches", f"""
        SELECT request_id, first_line query, post_id, relevance FROM {prefix}shown JOIN {prefix}lmatches USING (request_id)
        UNION ALL SELECT request_id, keywords, post_id, relevance FROM {prefix}shown JOIN {prefix}wmatches USING (request_id)
        WHERE request_id NOT IN (SELECT request_id FROM {prefix}lmatches)""")
    return ranked_blocks(prefix, f"{prefix}found", f"{prefix}shown", "error_posts", "part_profile", "tag_stats", ("<pre>", "</pre>"))


block("compile_errors", "j_keywords gated_messages", """SELECT run_id, keywords, any_value(user_id) user_id,
    replace(string_split(arg_min(text, pos) FILTER (category = 'ERROR'), chr(10))[1], ':', '') first_line
    FROM j_keywords JOIN gated_messages USING (run_id) GROUP BY ALL""")
oracle("compile_error_search", error_blocks("ce_", "compile_errors"), "SELECT * FROM ce_ranked")
block("runtime_errors", "k_keywords run_messages", """SELECT run_id, keywords, string_split(run_id, ':')[1]::BIGINT user_id,
    replace(string_split(text, chr(10))[1], ':', '') first_line
    FROM k_keywords JOIN run_messages USING (run_id) WHERE category = 'ERROR'""")
oracle("runtime_error_search", error_blocks("re_", "runtime_errors"), "SELECT * FROM re_ranked")

block("part_posts", "parts", f"""SELECT post_id, title, coalesce(body, '') body, coalesce(tags, []::VARCHAR[]) tags, votes, created, active,
    regexp_extract_all(lower(title || chr(10) || coalesce(body, '')), {WORDS}) post_terms FROM parts""")
index_blocks("part_", "part_posts")
PROJECT = "'p' || (event_id // 500 % 2)"


def stuck_blocks(prefix: str, who: str, user: str) -> str:
    """Blocks from raw edits to ranked results, with a machine for each `who`; the last one is `<prefix>vranked`."""
    block(f"{prefix}y", "classified", f"SELECT {who} user_id, event_id, ts, kind FROM classified")
    machine_blocks(prefix, f"{prefix}y")
    block(f"{prefix}stuck", f"{prefix}fired event_contexts generous visible", f"""SELECT * FROM (
        SELECT f.user_id || ':' || event_id context_id, {user.format("f.user_id")} user_id, text, caret_line
        FROM (SELECT DISTINCT user_id, event_id FROM {prefix}fired) f JOIN event_contexts c USING (event_id))
        WHERE user_id IN (SELECT user_id FROM visible) AND {gate('difficulty', 'generous')}""")
    block(f"{prefix}terms", f"{prefix}stuck", rf"""
        SELECT context_id, user_id, unnest(string_split(lower(imported), '.')) term FROM (SELECT context_id, user_id,
          unnest(regexp_extract_all(text, 'import\s+([\w.]*\w);', 1)) imported FROM {prefix}stuck)
        UNION SELECT context_id, user_id, unnest(CASE WHEN line = '' THEN [''] ELSE regexp_extract_all(lower(line), {PIECES}) END)
        FROM (SELECT context_id, user_id, string_split(text, chr(10))[caret_line + 1] line FROM {prefix}stuck) WHERE line IS NOT NULL""")
    block(f"{prefix}scored", f"{prefix}terms name_stats", f"""SELECT context_id, user_id, term, coalesce({SCQ}, 0)
        + coalesce({SCQ} / (SELECT count(*) FROM part), 0) + coalesce(ictf, 0) + coalesce(idf, 0) score
        FROM {prefix}terms LEFT JOIN name_stats USING (term)""")
    block(f"{prefix}ready", f"{prefix}scored", f"""SELECT * FROM (SELECT context_id request_id, user_id, string_agg(term, ' ' ORDER BY place) q,
        'relevance' sort FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY score DESC, term) place FROM {prefix}scored)
        WHERE place <= 4 GROUP BY context_id, user_id) WHERE q <> ''""")
    block(f"{prefix}vrequests", f"{prefix}ready", f"SELECT request_id, q, []::VARCHAR[] tags, TRUE backoff FROM {prefix}ready")
    marks = ("<pre>", "</pre>")
    return search_blocks(f"{prefix}v", f"{prefix}ready", "part_posts", "part_postings", "part_terms", "part_profile", "tag_stats", marks)


oracle("difficulty_to_search", stuck_blocks("z_", "user_id", "{}"), "SELECT * FROM z_vranked")
oracle("difficulty_to_search_by_project",
       stuck_blocks("zp_", f"{PROJECT} || ':' || user_id", "string_split({}, ':')[2]::BIGINT"), "SELECT * FROM zp_vranked")
block("pe_y", "editor", f"SELECT {PROJECT} || ':' || user_id user_id, event_id, ts, kind FROM editor")
oracle("difficulty_events_by_project", f"{machine_blocks('pe_', 'pe_y')} generous visible", f"""SELECT * FROM (
      SELECT string_split(user_id, ':')[1] project, string_split(user_id, ':')[2]::BIGINT user_id, ts, event_id,
        event DifficultyEventType, state "State", scroll, click, "insert", "delete" FROM pe_log)
    WHERE DifficultyEventType = 'transition' OR user_id IN (SELECT user_id FROM visible) AND {gate('difficulty', 'generous')}""")
