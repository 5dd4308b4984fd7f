"""The results of :mod:`checks.queries` as plain SQL over the same tables."""

from __future__ import annotations

from labelmill import fixed_values as fixed
from labelmill.functions import prompts
from labelmill.functions.text import PUNCTUATION, WHITE_SPACE

from checks.queries import LANGUAGES, LIMIT, WORDS


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(quoted(value) for value in values)


def tokens(text: str) -> str:
    return rf"len(regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\x0b\x{{85}}\p{{Z}}]'))"


SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def strip(text: str) -> str:
    return f"trim({text}, {quoted(WHITE_SPACE)})"


def packed(pieces: str, limit: int, glue: str, paragraphs: bool) -> str:
    """A list of segments, folded over the pieces."""
    if paragraphs:
        # From the definition: a separator stands between two pieces of a segment, and its tokens count.
        total = f"CASE WHEN a.open IS NULL THEN b.size ELSE a.size + {tokens(glue)} + b.size END"
        return f"""list_reduce(
            list_transform({pieces}, lambda p: {{'done': []::VARCHAR[], 'open': p, 'size': {tokens('p')}}}),
            lambda a, b: {{
                'done': CASE WHEN a.open IS NULL OR {total} <= {limit} THEN a.done ELSE list_append(a.done, {strip('a.open')}) END,
                'open': CASE WHEN a.open IS NULL THEN b.open WHEN {total} <= {limit} THEN a.open || {glue} || b.open ELSE b.open END,
                'size': CASE WHEN {total} <= {limit} THEN {total} ELSE b.size END}},
            {{'done': []::VARCHAR[], 'open': NULL::VARCHAR, 'size': 0::BIGINT}})"""
    done = "a.open"
    fold = f"""list_reduce(
        list_transform({pieces}, lambda p: {{'done': []::VARCHAR[], 'open': p, 'size': {tokens('p')}}}),
        lambda a, b: {{
            'done': CASE WHEN a.size + b.size <= {limit} THEN a.done ELSE list_append(a.done, {done}) END,
            'open': CASE WHEN a.size + b.size <= {limit} THEN a.open || {glue} || b.open ELSE b.open END,
            'size': CASE WHEN a.size + b.size <= {limit} THEN a.size + b.size ELSE b.size END}},
        {{'done': []::VARCHAR[], 'open': '', 'size': 0::BIGINT}})"""
    return fold


def closed(state: str, paragraphs: bool) -> str:
    last = strip(f"{state}.open") if paragraphs else f"{state}.open"
    none = "IS NULL" if paragraphs else "= ''"
    return f"CASE WHEN {state}.open {none} THEN {state}.done ELSE list_append({state}.done, {last}) END"


def paragraphs(text: str, limit: int = LIMIT, glue: str = "chr(10)") -> str:
    return packed(f"string_split({text}, {glue})", limit, glue, True)


def sentences(text: str, limit: int) -> str:
    pieces = rf"string_split(regexp_replace({text}, '([.!?])[\s\x0b\x{{85}}\p{{Z}}]+', '\1' || chr(57344), 'g'), chr(57344))"
    return packed(pieces, limit, "''", False)


def segments(source: str, keys: str, text: str = "text", limit: int = LIMIT, glue: str = "chr(10)") -> str:
    """Rows (keys, seg, text) of packed paragraphs."""
    return f"""
        WITH folded AS (SELECT {keys}, {paragraphs(text, limit, glue)} AS s FROM {source}),
        lists AS (SELECT {keys}, {closed('s', True)} AS segs FROM folded)
        SELECT {keys}, unnest(range(len(segs))) AS seg, unnest(segs) AS text FROM lists"""


WORD_LIST = listed(WORDS)
LANGUAGE_OF = "CASE " + " ".join(f"WHEN {{0}} = {quoted(word)} THEN {quoted(lang)}" for word, lang in WORDS.items()) + " END"


def word_rule(text: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+'), lambda x: x IN ({WORD_LIST}))[1]"


def whitespace_rule(text: str, trim: bool = True) -> str:
    token = f"trim(x, {quoted(PUNCTUATION)})" if trim else "x"
    split = f"list_transform(regexp_split_to_array(lower({text}), '{SPACE}'), lambda x: {token})"
    return f"list_filter({split}, lambda x: x IN ({WORD_LIST}))[1]"


def substring_rule(text: str, labels, default: str) -> str:
    cases = " ".join(f"WHEN contains({text}, {quoted(label)}) THEN {quoted(label)}" for label in labels)
    return f"CASE {cases} ELSE {default} END"


RULES = {
    "word": word_rule("text"),
    "whitespace": whitespace_rule("text"),
    "bare": whitespace_rule("text", False),
    "substring": substring_rule("text", WORDS, "NULL"),
}
FOUND = "found AS (SELECT doc_id, lang, source, " + ", ".join(f"{sql} AS {name}_w" for name, sql in RULES.items()) + " FROM documents)"
RATED = (
    FOUND
    + ", rated AS (SELECT doc_id, lang, source, "
    + ", ".join(f"{LANGUAGE_OF.format(name + '_w')} AS {name}" for name in RULES)
    + " FROM found)"
)

MARKERS = """markers AS (
    SELECT row_number() OVER (ORDER BY conv_no, turn) - 1 AS row_id, conv_no, turn + 1 AS turn, speaker, text FROM (
        SELECT conv_id AS conv_no, turn, role AS speaker, text FROM conversations
        UNION ALL
        SELECT DISTINCT conv_id, -1, 'Dialogue' || conv_id, '' FROM conversations)),
    numbered AS (SELECT row_id, speaker, text, dense_rank() OVER (ORDER BY conv_no) - 1 AS conv_no, turn FROM markers)"""

SPEAKERS = """firsts AS (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY ALL),
    numbers AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY f) - 1 AS speaker_no FROM firsts)"""

UTTERANCES = """lists AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents),
    utterances AS (SELECT doc_id, source, unnest(range(len(parts))) AS turn, unnest(parts) AS text FROM lists),
    spoken AS (SELECT *, lower(substr(text, 1, 1)) AS letter FROM utterances),
    firsts AS (SELECT doc_id, letter, min(turn) AS f FROM spoken GROUP BY ALL),
    numbers AS (SELECT doc_id, letter, row_number() OVER (PARTITION BY doc_id ORDER BY f) - 1 AS speaker_no FROM firsts)"""


def report(rated: str, gold: str, said: str, labels, by: str = "") -> str:
    """Long report rows with ``by`` columns, ordinal, label, precision, recall, f1, support."""
    keys = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON true"
    lists = f"(SELECT * FROM (VALUES {', '.join(f'({i}::BIGINT, {quoted(label)})' for i, label in enumerate(labels))}) v(ordinal, label))"
    inside = f"IN ({listed(labels)})"
    group = f"GROUP BY {by}" if by else ""
    return f"""
    heads AS (SELECT {keys}count(*) AS n, sum(({gold} = {said} AND {gold} IS NOT NULL)::INT) AS hits,
        sum((NOT coalesce({gold} {inside}, false) OR NOT coalesce({said} {inside}, false))::INT) AS outside
        FROM {rated} {group}),
    cells AS (SELECT {keys}ordinal, label, sum(coalesce(({gold} = label AND {said} = label)::INT, 0)) AS tp,
        sum(coalesce(({said} = label)::INT, 0)) AS pred, sum(coalesce(({gold} = label)::INT, 0)) AS support
        FROM {rated} CROSS JOIN {lists} GROUP BY {keys}ordinal, label),
    scored AS (SELECT {keys}ordinal, label, tp, pred, support,
        CASE WHEN pred = 0 THEN 0e0 ELSE tp::DOUBLE / pred END AS precision,
        CASE WHEN support = 0 THEN 0e0 ELSE tp::DOUBLE / support END AS recall,
        CASE WHEN pred + support = 0 THEN 0e0 ELSE 2 * tp::DOUBLE / (pred + support) END AS f1 FROM cells),
    sums AS (SELECT {keys}sum(tp) AS tp, sum(pred) AS pred, sum(support) AS support,
        avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
        sum(precision * support) / nullif(sum(support), 0) AS wp, sum(recall * support) / nullif(sum(support), 0) AS wr,
        sum(f1 * support) / nullif(sum(support), 0) AS wf FROM scored {group}),
    lines AS (
        SELECT {keys}ordinal, label, precision, recall, f1, support FROM scored
        UNION ALL
        SELECT {keys}{len(labels)}, CASE WHEN outside = 0 THEN 'accuracy' ELSE 'micro avg' END,
            CASE WHEN outside = 0 THEN hits::DOUBLE / n WHEN pred = 0 THEN 0 ELSE tp::DOUBLE / pred END,
            CASE WHEN outside = 0 THEN hits::DOUBLE / n WHEN support = 0 THEN 0 ELSE tp::DOUBLE / support END,
            CASE WHEN outside = 0 THEN hits::DOUBLE / n WHEN pred + support = 0 THEN 0 ELSE 2 * tp::DOUBLE / (pred + support) END,
            support FROM sums JOIN heads {on}
        UNION ALL SELECT {keys}{len(labels) + 1}, 'macro avg', mp, mr, mf, support FROM sums
        UNION ALL SELECT {keys}{len(labels) + 2}, 'weighted avg', coalesce(wp, 0), coalesce(wr, 0), coalesce(wf, 0), support FROM sums)"""


LINE = "ordinal::BIGINT AS ordinal, label, round(precision, 10) AS precision, round(recall, 10) AS recall, round(f1, 10) AS f1, support::BIGINT AS support"

RUN_ROWS = (
    f"WITH {RATED}, preds AS ("
    + " UNION ALL ".join(f"SELECT source AS dataset, '{name}' AS model_id, lang AS gold, {name} AS said FROM rated" for name in RULES)
    + ")"
)


def reports() -> str:
    parts = []
    for target, labels in (("language", LANGUAGES), ("without_es", LANGUAGES[:3])):
        parts.append(
            f"SELECT dataset, model_id, 'words=12' AS generation_config, '{target}' AS target, * EXCLUDE (dataset, model_id) FROM ("
            f"{RUN_ROWS}, {report('preds', 'gold', 'said', labels, 'dataset, model_id')} SELECT * FROM lines)"
        )
    return " UNION ALL ".join(parts)


BOARD = f"""board AS (SELECT target, dataset, model_id, generation_config, 'weighted avg_f1-score' AS metric, round(f1, 5) AS score
    FROM ({reports()}) WHERE label = 'weighted avg')"""


def key(row_id: str, seed: int) -> str:
    return f"md5({row_id}::VARCHAR || '-{seed}')"


def _prompt(target: str, shots, roles: bool = False) -> str:
    context = prompts.task_context(target, shots)
    if not roles:
        return f"md5({quoted(context + '<')} || text || '> =') AS {target}_prompt"
    head = f"<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n{context.strip()}<|eot_id|>"
    head += "<|start_header_id|>user<|end_header_id|>\n\n<"
    tail = "> =<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"
    return f"md5({quoted(head)} || text || {quoted(tail)}) AS {target}_prompt"


def prompt_sql(shots, roles: bool = False) -> str:
    return "SELECT doc_id, " + ", ".join(_prompt(target, shots, roles) for target in prompts.TARGETS) + " FROM documents"


def filled(template: str, **parts: str) -> str:
    """The template as a SQL expression with ``{name}`` replaced by SQL values."""
    sql = quoted(template)
    for name, value in parts.items():
        sql = f"replace({sql}, '{{{name}}}', {value})"
    return sql


def scorer(prompt_length: str) -> str:
    return f"CASE ({prompt_length}) % 3 WHEN 0 THEN 'Happiness. Positive!' WHEN 1 THEN 'other, neutral' ELSE 'none of them' END"


def answered(raw: str) -> str:
    return f"""CASE {raw} WHEN 'Happiness. Positive!' THEN 'happiness' WHEN 'other, neutral' THEN 'other' END AS llama3_emotion"""


def answered_sentiment(raw: str) -> str:
    return f"""CASE {raw} WHEN 'Happiness. Positive!' THEN 'positive' WHEN 'other, neutral' THEN 'neutral' END AS llama3_sentiment"""


def role_length(target: str) -> str:
    fixed_part = len("<|begin_of_text|>") + 2 * len("<|eot_id|>") + len("<|start_header_id|>system<|end_header_id|>\n\n")
    fixed_part += len("<|start_header_id|>user<|end_header_id|>\n\n") + len("<|start_header_id|>assistant<|end_header_id|>\n\n")
    fixed_part += len(prompts.task_context(target, 0).strip()) + len("<> =")
    return f"{fixed_part} + length(text)"


def files_sql() -> dict[str, str]:
    """What is read back from files, and runs whose rows are not those of the gold table."""
    posts = "md5(nullif(text, '')) AS text"
    place = "row_number() OVER (ORDER BY doc_id) - 1 AS row_id"
    found = f"SELECT doc_id, {posts}, lang, n_chars, {place} FROM documents"
    mood = lambda c: f"CASE {c} {' '.join(f'WHEN {quoted(a)} THEN {quoted(b)}' for a, b in zip(LANGUAGES, fixed.SENTIMENTS + fixed.SENTIMENTS[:1]))} END"
    said = " UNION ALL ".join(f"SELECT source, doc_id, lang, '{rule}' AS model_id, {rule} AS said FROM rated" for rule in RULES)
    uneven = f"""{RATED}, told AS ({said}),
        given AS (SELECT source AS dataset, doc_id AS row_id, model_id, said FROM told WHERE model_id <> 'whitespace' OR doc_id % 7 <> 0
            UNION ALL SELECT source, doc_id, model_id, 'de' FROM told WHERE model_id = 'bare' AND doc_id % 5 = 0
            UNION ALL SELECT source, -doc_id - 1, model_id, said FROM told WHERE model_id = 'substring' AND doc_id % 3 = 0),
        once AS (SELECT dataset, row_id, model_id, count(*) AS n,
            CASE WHEN count(*) > count(said) THEN NULL ELSE min(said) END AS said FROM given GROUP BY dataset, row_id, model_id),
        models AS (SELECT DISTINCT dataset, model_id FROM given),
        whole AS (SELECT m.dataset, m.model_id, d.doc_id AS row_id, d.lang AS gold, o.said
            FROM models m JOIN documents d ON d.source = m.dataset
            LEFT JOIN once o ON o.dataset = m.dataset AND o.model_id = m.model_id AND o.row_id = d.doc_id)"""
    tree = f"""{RATED}, told AS (SELECT source AS dataset, 'word' AS model_id, {mood('lang')} AS gold, {mood('word')} AS said FROM rated
        UNION ALL SELECT source, 'bare', {mood('lang')}, {mood('bare')} FROM rated)"""
    both = len(prompts.task_context("emotion_and_sentiment", True)) + 4
    named = lambda config, target: f"'{config}' AS generation_config, '{target}' AS target, {LINE}"
    return {
        "csv_in_ranges": found, "csv_one_task": found, "json_array": found.replace(posts, "md5(text) AS text"),
        "csv_headerless": f"SELECT lang AS sentiment, {posts}, doc_id::VARCHAR AS id, {place} FROM documents",
        "csv_records": f"""SELECT doc_id::VARCHAR AS doc_id, md5(coalesce(text, '')) AS text, CASE WHEN n_chars % 3 > 0 THEN lang ELSE '' END AS lang,
            n_chars::VARCHAR AS n_chars, {place} FROM documents""",
        "csv_indexed": f"""SELECT row_id AS place, * FROM (SELECT doc_id, {posts}, lang, n_chars,
            row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS row_id FROM documents)""",
        "csv_splits": f"""SELECT doc_id, {posts}, lang, n_chars, 'part=' || lang AS split,
            row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS row_id FROM documents WHERE lang IN ('de', 'en')""",
        "jsonl_conversations": """SELECT dense_rank() OVER (ORDER BY conv_id::VARCHAR) - 1 AS row_id, conv_id::VARCHAR AS filename,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role AS speaker, md5(text) AS text FROM conversations""",
        "text_lines": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
            u AS (SELECT doc_id, unnest(range(len(parts))) AS k, unnest(parts) AS line FROM l)
            SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS row_id, md5(line) AS line FROM u""",
        "appended_once": "SELECT doc_id, md5(text) AS text, CASE WHEN doc_id % 3 <> 0 THEN 'first' ELSE lang END AS lang, n_chars FROM documents",
        "answer_log": f"SELECT doc_id, {scorer('length(text) + 4')} AS raw FROM documents",
        "prediction_tables": f"""SELECT id, {place}, raw AS llama3_raw, {answered('raw')}, {answered_sentiment('raw')}
            FROM (SELECT doc_id, doc_id::VARCHAR AS id, {scorer(f'length(text) + {both}')} AS raw FROM documents)""",
        "report_uneven_runs": f"""WITH {uneven}, {report('whole', 'gold', 'said', LANGUAGES, 'dataset, model_id')}
            SELECT dataset, model_id, {named('words=12', 'language')} FROM lines""",
        "run_coverage": f"""WITH {uneven}, golds AS (SELECT source AS dataset, count(*) AS gold_rows FROM documents GROUP BY source),
            met AS (SELECT o.*, d.doc_id IS NOT NULL AS has FROM once o LEFT JOIN documents d ON d.source = o.dataset AND d.doc_id = o.row_id)
            SELECT dataset, model_id, 'words=12' AS generation_config, gold_rows, sum(n)::BIGINT AS own_rows,
                (gold_rows - count_if(has))::BIGINT AS missing, (sum(n) - count(*))::BIGINT AS repeated, count_if(NOT has)::BIGINT AS surplus
            FROM met JOIN golds USING (dataset) GROUP BY dataset, model_id, gold_rows""",
        "report_folder_tree": f"""WITH {tree}, {report('told', 'gold', 'said', fixed.SENTIMENTS, 'dataset, model_id')}
            SELECT dataset, model_id, {named('all', 'sentiment')} FROM lines""",
        "report_arriving_runs": f"""WITH {tree}, {report('told', 'gold', 'said', fixed.SENTIMENTS, 'dataset, model_id')}
            SELECT dataset, model_id, {named('all', 'sentiment')} FROM lines""",
    }


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    # text
    sql["mask_mentions"] = r"SELECT doc_id, regexp_replace(text, '@[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+', '@user', 'g') AS text FROM documents"
    sql["token_count"] = f"""SELECT doc_id, {tokens('text')}::BIGINT AS tokens, ({tokens('text')} > {LIMIT})::BIGINT AS is_lengthy
        FROM documents"""
    sql["pack_paragraphs"] = f"SELECT *, {tokens('text')}::BIGINT AS tokens FROM ({segments('documents', 'doc_id')})"
    for name, limit, keep in (("pack_sentences", LIMIT, False), ("pack_sentences_with_empty_head", 20, True)):
        kept = "segs" if keep else "list_filter(segs, lambda x: x <> '')"
        sql[name] = f"""
        WITH folded AS (SELECT doc_id, {sentences('text', limit)} AS s FROM documents),
        lists AS (SELECT doc_id, {closed('s', False)} AS segs FROM folded),
        kept AS (SELECT doc_id, {kept} AS segs FROM lists)
        SELECT doc_id, unnest(range(len(segs))) AS seg, unnest(segs) AS text FROM kept"""
    sql["first_label_word"] = f"SELECT doc_id, {RULES['word']} AS label FROM documents"
    sql["first_label_whitespace"] = f"SELECT doc_id, {RULES['whitespace']} AS label FROM documents"
    sql["first_label_bare"] = f"SELECT doc_id, {RULES['bare']} AS label FROM documents"
    sql["label_by_substring"] = f"SELECT doc_id, {substring_rule('text', ('ing', 'ment', 'ung'), quoted('none'))} AS label FROM documents"
    sql["strip_echo"] = """SELECT doc_id, string_split(text, '. ')[-1] AS after_stop,
        string_split('<' || source || '> = ' || text, '<' || source || '> =')[-1] AS after_prompt FROM documents"""

    # prompts
    sql["prompt_zero_shot"] = prompt_sql(0)
    sql["prompt_few_shot"] = prompt_sql(True)
    sql["prompt_one_example"] = prompt_sql(1)
    sql["prompt_roles"] = prompt_sql(True, roles=True)
    sql["chat_messages"] = f"""SELECT doc_id, 0::BIGINT AS pos, 'system' AS role, md5({quoted(fixed.EMOTION_CONTEXT)}) AS content FROM documents
        UNION ALL SELECT doc_id, 1, 'user', md5('<' || text || '> =') FROM documents"""
    headline = quoted(fixed.HEADLINE_CONTEXT + "[")
    sql["headline_prompt"] = f"""SELECT doc_id, md5({headline} || text || '] = ' || lang) AS training,
        md5({headline} || text || '] =') AS testing FROM documents"""
    seen = "(SELECT string_agg(l, ' or ' ORDER BY l) FROM (SELECT lang AS l FROM documents UNION SELECT role FROM conversations))"
    langs = "(SELECT string_agg(l, ' or ' ORDER BY l) FROM (SELECT DISTINCT lang AS l FROM documents))"
    single = filled(fixed.SENTIMENT_TEMPLATE, labels=seen)
    pair = filled(fixed.EMOTION_SENTIMENT_TEMPLATE, emotion_labels=langs, sentiment_labels="'yes or no'")
    sql["label_context"] = f"""SELECT doc_id, md5({single} || '<' || text || '> = ') AS single,
        md5({pair} || '<' || text || '> = ') AS pair FROM documents"""
    context = prompts.task_context("emotion", True)
    sql["training_table"] = f"""SELECT doc_id, md5({quoted(context + '<')} || text || '> =') AS text, lang AS label, source AS sentiment
        FROM documents"""

    # names and flags
    sql["dataset_name"] = "SELECT page_id, string_split(string_split(url, '/')[-1], '.')[1] AS dataset FROM pages"
    sql["parse_flag"] = "SELECT doc_id, quality = 1 AS quality, toxic = 1 AS toxic, CASE WHEN quality = 1 THEN 'true' END AS lenient FROM labels"
    sql["run_folder"] = """SELECT doc_id, 'max_new_toks=' || n_chars || '-temp=0.01-rep_pen=1.05-combine_prompts='
        || CASE WHEN quality = 1 THEN 'True' ELSE 'False' END || '-few_shots=' || CASE WHEN toxic = 1 THEN 'True' ELSE 'False' END
        || '-include_roles=' || CASE WHEN lang = 'en' THEN 'True' ELSE 'False' END AS config, source || doc_id AS id
        FROM labels JOIN documents USING (doc_id)"""

    # flat tables
    sql["select_rename_blank"] = """SELECT doc_id, coalesce(nullif(lang, 'es'), ' ') AS lang, '' AS source, n_chars AS size,
        source AS copy FROM documents"""
    sql["filter_missing_text"] = """WITH r AS (SELECT conv_id AS conv_no, turn,
            CASE WHEN role <> 'system' THEN 'SPEAKER_' || role END AS speaker, CASE WHEN role <> 'user' THEN text END AS text
            FROM conversations)
        SELECT * FROM r WHERE NOT (speaker IS NOT NULL AND coalesce(text, '') = '') AND text IS NOT NULL
        UNION ALL SELECT conv_no, turn, speaker, 'none' FROM r WHERE text IS NULL"""
    sql["stratum_counts"] = f"""WITH s AS ({segments('documents', 'doc_id, source')})
        SELECT CASE WHEN contains(source, 'src1') THEN 'C' ELSE 'D' END AS stratum, count(DISTINCT doc_id) AS conversations,
        count(*) AS utterances FROM s GROUP BY 1"""
    sql["label_to_id"] = """SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 1 END::BIGINT AS with_default,
        CASE lang WHEN 'en' THEN 'english' WHEN 'es' THEN 'spanish' END AS without_default FROM documents"""
    sql["label_by_table"] = "SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS source_size FROM documents"
    sql["member_flags"] = """SELECT conv_id AS conv_no, turn, conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system') AS is_member
        FROM conversations"""
    sql["disagreements"] = f"""WITH {RATED} SELECT doc_id AS row_id, '' AS correct, 0::BIGINT AS errors FROM rated
        WHERE word IS DISTINCT FROM substring"""
    sql["residual_rows"] = """SELECT doc_id, lang FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND (quality = 1 OR toxic = 1))"""
    sql["rows_except"] = "SELECT lang, source FROM documents WHERE lang <> 'en'"
    sql["distinct_labels"] = "SELECT lang AS label FROM documents UNION SELECT role FROM conversations"

    # positions
    sql["row_numbers"] = "SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS row_id FROM documents"
    sql["file_positions"] = "SELECT row_number() OVER () - 1 AS row_id, doc_id, lang FROM documents"
    sql["running_totals"] = """SELECT doc_id, lang, n_chars, sum(n_chars) OVER w::BIGINT AS chars, max(n_chars) OVER w AS longest
        FROM documents WINDOW w AS (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING)"""
    sql["slice_rows"] = """SELECT doc_id, lang, 0::BIGINT AS part FROM documents WHERE doc_id BETWEEN 100 AND 249
        UNION ALL SELECT doc_id, lang, 1 FROM documents WHERE doc_id < (SELECT floor(count(*) * 0.15e0) FROM documents)
        UNION ALL SELECT doc_id, lang, 2 FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents)
        UNION ALL SELECT doc_id, lang, 3 FROM documents WHERE doc_id < 22"""
    sql["concat_ranges"] = """SELECT doc_id AS row_id, doc_id, lang FROM documents WHERE doc_id < 75
        UNION ALL SELECT doc_id - 525, doc_id, lang FROM documents WHERE doc_id BETWEEN 600 AND 674
        UNION ALL SELECT doc_id + 100, doc_id, lang FROM documents WHERE doc_id BETWEEN 50 AND 59
        UNION ALL SELECT doc_id - 540, doc_id, lang FROM documents WHERE doc_id >= 700"""
    sql["qc_batches"] = """WITH p AS (SELECT doc_id, doc_id < 60 AS is_qc, CASE WHEN doc_id < 60 THEN doc_id ELSE doc_id - 60 END AS place
            FROM documents),
        b AS (SELECT *, least(place // CASE WHEN is_qc THEN 15 ELSE 105 END, 3) AS batch FROM p)
        SELECT doc_id, is_qc, batch, row_number() OVER (PARTITION BY batch ORDER BY is_qc DESC, place) - 1 AS batch_pos FROM b"""
    sql["qc_restore"] = "SELECT doc_id, lang FROM documents"

    # conversations
    sql["dialogue_number"] = f"WITH {MARKERS} SELECT row_id, speaker, conv_no, turn FROM numbered"
    sql["chunk_relabel"] = f"""WITH {MARKERS},
        both_tables AS (SELECT 'E' AS source, conv_no, turn FROM numbered UNION ALL SELECT 'D', doc_id, 0 FROM documents),
        sizes AS (SELECT source, (max(conv_no) + 1) // 7 AS size FROM both_tables GROUP BY source),
        chunked AS (SELECT source, conv_no, turn, least(conv_no // size, 6) AS chunk FROM both_tables JOIN sizes USING (source))
        SELECT source, conv_no, turn, chunk, dense_rank() OVER (ORDER BY chunk, source, conv_no) - 1 AS new_conv_no FROM chunked"""
    sql["rows_before_dialogue"] = f"WITH {MARKERS} SELECT row_id, conv_no FROM numbered WHERE conv_no < 22"
    sql["speaker_number"] = f"""WITH {SPEAKERS} SELECT conv_id AS conv_no, turn, role AS speaker, speaker_no
        FROM conversations JOIN numbers USING (conv_id, role)"""
    rows = segments("conversations", "conv_id, turn, role")
    lines = segments("spoken", "doc_id, source, turn, letter", limit=30, glue="'. '")
    sql["utterance_rows"] = f"""WITH {UTTERANCES}, segs AS ({lines})
        SELECT doc_id AS conv_no, turn, seg, 'Speaker_' || speaker_no AS speaker, text FROM segs JOIN numbers USING (doc_id, letter)
        UNION ALL SELECT doc_id, -1, -1, 'Dialogue' || doc_id, '' FROM documents"""
    sql["utterance_rows_unpacked"] = f"""WITH {UTTERANCES}
        SELECT doc_id AS conv_no, source AS filename, turn, 0::BIGINT AS seg, 'Speaker_' || speaker_no AS speaker, text
        FROM spoken JOIN numbers USING (doc_id, letter)"""
    sql["rebuild_conversation"] = """SELECT conv_id AS conv_no, turn // 3 AS part,
        string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS conversation FROM conversations GROUP BY ALL"""
    sql["annotated_conversation"] = """SELECT conv_id AS conv_no, 0::BIGINT AS part, true AS first_matches, 3 * count(*) AS votes
        FROM conversations GROUP BY conv_id"""
    sql["split_annotated_rows"] = f"""WITH segs AS ({rows}),
        many AS (SELECT conv_id, turn, count(*) AS n FROM segs GROUP BY ALL)
        SELECT s.conv_id AS conv_no, s.turn, s.seg, s.role AS speaker, CASE WHEN n > 1 THEN s.text ELSE c.text END AS text,
        CASE WHEN n > 1 THEN '' ELSE s.role END AS remarks
        FROM segs s JOIN many USING (conv_id, turn) JOIN conversations c ON c.conv_id = s.conv_id AND c.turn = s.turn"""
    sql["sampled_segments"] = f"""WITH {UTTERANCES}, segs AS ({lines}),
        sizes AS (SELECT doc_id, CASE WHEN contains(source, 'src1') THEN 'C' ELSE 'D' END AS stratum, count(*) AS size
            FROM segs GROUP BY doc_id, source),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY doc_id) - 1 AS earlier FROM sizes),
        taken AS (SELECT *, CASE stratum WHEN 'C' THEN earlier + 2 < 51 ELSE earlier + 3 < 251 END AS ok FROM ranked),
        walked AS (SELECT *, 30 + sum(CASE WHEN ok THEN size ELSE 0 END) OVER (ORDER BY doc_id) - CASE WHEN ok THEN size ELSE 0 END AS size_before
            FROM taken),
        kept AS (SELECT doc_id, stratum FROM walked WHERE ok AND size_before < 2000)
        SELECT doc_id AS conv_no, stratum, turn, seg, 'Speaker_' || speaker_no AS speaker, text
        FROM segs JOIN kept USING (doc_id) JOIN numbers USING (doc_id, letter)
        UNION ALL SELECT doc_id, stratum, -1, -1, 'Dialogue' || doc_id, '' FROM kept"""

    # samples
    sql["quota_walk"] = f"""WITH segs AS ({segments('documents', 'doc_id, lang')}),
        sizes AS (SELECT doc_id, lang, count(*) AS size FROM segs GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 + CASE lang WHEN 'en' THEN 5 ELSE 0 END AS earlier FROM sizes),
        taken AS (SELECT *, CASE lang WHEN 'en' THEN earlier < 200.5 WHEN 'fr' THEN earlier < 40 WHEN 'de' THEN earlier < 1000
            ELSE false END AS ok FROM ranked),
        walked AS (SELECT *, sum(CASE WHEN ok THEN size ELSE 0 END) OVER (ORDER BY doc_id) - CASE WHEN ok THEN size ELSE 0 END + 12 AS size_before
            FROM taken)
        SELECT doc_id, lang, size, earlier AS kept_before, size_before::BIGINT AS size_before FROM walked WHERE ok AND size_before < 2000"""
    sql["shuffle_rank"] = f"""SELECT doc_id, lang, row_number() OVER (ORDER BY {key('doc_id', 14)}, doc_id) - 1 AS position,
        row_number() OVER (PARTITION BY lang ORDER BY {key('doc_id', 10)}, doc_id) - 1 AS position_in_lang FROM documents"""
    sql["seeded_shuffle"] = "SELECT doc_id, lang FROM documents"
    sql["stratified_split"] = f"""WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        whole AS (SELECT sum(n)::BIGINT AS total, (sum(n) - ceil(0.7e0 * sum(n)))::BIGINT AS train FROM sizes),
        shares AS (SELECT source, (train * n) // total AS base, (train * n) % total AS rest FROM sizes, whole),
        ordered AS (SELECT *, row_number() OVER (ORDER BY rest DESC, source) AS place FROM shares),
        quotas AS (SELECT source, base + CASE WHEN place <= (SELECT train FROM whole) - (SELECT sum(base) FROM shares) THEN 1 ELSE 0 END AS quota
            FROM ordered),
        ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {key('doc_id', 88)}, doc_id) AS place FROM documents)
        SELECT doc_id, source, CASE WHEN place <= quota THEN 'train' ELSE 'test' END AS split FROM ranked JOIN quotas USING (source)"""
    sql["fixed_split"] = f"""WITH ranked AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {key('doc_id', 42)}, doc_id) AS place
            FROM documents)
        SELECT doc_id, lang, CASE WHEN place <= 5 THEN 'train' WHEN place <= 12 THEN 'test' ELSE 'rest' END AS split FROM ranked"""
    sql["random_split"] = f"""WITH ranked AS (SELECT doc_id, lang, row_number() OVER (ORDER BY {key('doc_id', 42)}, doc_id) AS place,
            count(*) OVER () AS n FROM documents)
        SELECT doc_id, lang, CASE WHEN place <= n - ceil(0.15e0 * n) THEN 'train' ELSE 'test' END AS split FROM ranked"""
    sql["bootstrap"] = f"""WITH ranked AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {key('doc_id', 10)}, doc_id) - 1 AS slot,
            count(*) OVER (PARTITION BY lang) AS n FROM documents),
        draws AS (SELECT DISTINCT lang, n, unnest(range(50)) AS draw FROM (SELECT DISTINCT lang, n FROM ranked)),
        picks AS (SELECT lang, draw, ('0x' || substr(md5(lang || '-' || draw || '-10'), 1, 8))::BIGINT % n AS slot FROM draws)
        SELECT doc_id, lang, draw FROM ranked JOIN picks USING (lang, slot)"""

    # scores
    sql["accuracy"] = f"""WITH {RATED} SELECT source, count(*) AS n, round(avg(CASE WHEN lang = word THEN 1e0 ELSE 0e0 END), 10) AS accuracy
        FROM rated GROUP BY source"""
    sql["accuracy_by_label"] = f"""WITH {RATED} SELECT label, count(doc_id) AS n,
        coalesce(round(avg(CASE WHEN doc_id IS NULL THEN NULL WHEN lang = word THEN 1e0 ELSE 0e0 END), 10), -1) AS accuracy
        FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('it')) v(label) LEFT JOIN rated ON lang = label GROUP BY label"""
    sql["accuracy_by_seen_label"] = f"""WITH {RATED} SELECT lang AS label, count(*) AS n,
        round(avg(CASE WHEN lang = bare THEN 1e0 ELSE 0e0 END), 10) AS accuracy FROM rated GROUP BY lang"""
    cells = ", ".join(f"count(*) FILTER (word = '{lang}') AS {lang}" for lang in LANGUAGES)
    sql["confusion_matrix"] = f"""WITH {RATED} SELECT list_position(['en', 'fr', 'de', 'es'], lang)::BIGINT - 1 AS ordinal, lang AS label, {cells}
        FROM rated GROUP BY lang"""
    sql["classification_report"] = f"WITH {RATED}, {report('rated', 'lang', 'word', [*LANGUAGES, 'it'])} SELECT {LINE} FROM lines"
    sql["classification_report_seen_labels"] = f"""WITH {RATED}, full_rated AS (SELECT * REPLACE (coalesce(bare, 'en') AS bare) FROM rated),
        {report('full_rated', 'lang', 'bare', LANGUAGES)} SELECT * EXCLUDE (ordinal) FROM (SELECT {LINE} FROM lines)"""
    sql["report_all_runs"] = f"SELECT dataset, model_id, generation_config, target, {LINE} FROM ({reports()})"
    sql |= files_sql()
    sql["leaderboard"] = f"WITH {BOARD} SELECT * FROM board"
    sql["top_runs"] = f"""WITH {BOARD} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, target
        ORDER BY score DESC, model_id, generation_config) AS rank FROM board) WHERE rank <= 2"""
    sql["report_document"] = f"""SELECT dataset, model_id, generation_config, target, string_agg(label, ',' ORDER BY ordinal) AS labels,
        string_agg(CASE WHEN label <> 'accuracy' THEN support::BIGINT::VARCHAR END, ',' ORDER BY ordinal) AS supports
        FROM ({reports()}) GROUP BY ALL"""
    sql["report_document_lines"] = f"""SELECT dataset, model_id, generation_config, target, ordinal::BIGINT AS ordinal, label,
        round(precision, 10) AS precision, round(recall, 10) AS recall, round(f1, 10) AS f1,
        CASE WHEN label <> 'accuracy' THEN support::DOUBLE END AS support FROM ({reports()})"""
    sql["annotated_turns"] = """SELECT conv_id AS conv_no, 0::BIGINT AS part, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn,
        role AS speaker, md5(text) AS text, role || ',' || role || ',' || role AS emotion, lower(role) AS sentiment FROM conversations"""
    sql["pending_runs"] = """WITH pairs AS (SELECT DISTINCT source, lang FROM documents),
        grid AS (SELECT * FROM (VALUES (true), (false)) c(combined), (VALUES ('0.01'), ('0.1')) t(temperature))
        SELECT source, lang, combined, temperature FROM pairs, grid WHERE NOT (lang = 'en' AND combined)"""
    sql["value_counts"] = f"WITH {RATED} SELECT word, count(*) AS n FROM rated WHERE word IS NOT NULL GROUP BY word"
    sql["describe_length"] = """SELECT count(*) AS count, round(avg(n_chars), 10) AS mean, round(stddev(n_chars), 10) AS std,
        min(n_chars)::DOUBLE AS min, quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS p50,
        quantile_cont(n_chars, 0.75) AS p75, max(n_chars)::DOUBLE AS max FROM documents"""
    votes = ", ".join(
        f"(coalesce((word = '{lang}')::INT, 0) + coalesce((whitespace = '{lang}')::INT, 0) + coalesce((substring = '{lang}')::INT, 0))::BIGINT AS {lang}"
        for lang in LANGUAGES
    )
    sql["rating_table"] = f"WITH {RATED} SELECT doc_id, {votes} FROM rated"
    long_form = " UNION ALL ".join(f"SELECT doc_id, source, {name} AS label FROM rated" for name in ("word", "whitespace", "substring"))
    sql["rating_counts"] = f"WITH {RATED} SELECT doc_id, label, count(*) AS n FROM ({long_form}) WHERE label IS NOT NULL GROUP BY ALL"
    kappas = []
    for by in ("'all'", "source"):
        kappas.append(f"""SELECT source, subjects::BIGINT AS subjects, incomplete::BIGINT AS incomplete,
            round(CASE WHEN chance < 1 THEN (observed - chance) / (1 - chance) END, 10) AS kappa FROM (
            SELECT source, s.subjects, s.incomplete, s.observed, coalesce(c.chance, 1) AS chance FROM
            (SELECT {by} AS source, sum((n = 3)::INT) AS subjects, sum((n < 3)::INT) AS incomplete,
                avg(CASE WHEN n = 3 THEN (squares - 3) / 6e0 END) AS observed FROM per_subject GROUP BY 1) s
            LEFT JOIN (SELECT source, sum(share * share) AS chance FROM (
                SELECT {by} AS source, label, sum(k) / sum(sum(k)) OVER (PARTITION BY {by})::DOUBLE AS share
                FROM counts JOIN per_subject USING (doc_id, source) WHERE per_subject.n = 3 GROUP BY 1, label{'' if by != 'source' else ', source'}) GROUP BY source) c USING (source))""")
    sql["fleiss_kappa"] = f"""WITH {RATED}, long AS ({long_form}),
        counts AS (SELECT doc_id, source, label, count(*) AS k FROM long WHERE label IS NOT NULL GROUP BY ALL),
        per_subject AS (SELECT r.doc_id, r.source, coalesce(sum(k), 0) AS n, coalesce(sum(k * k), 0) AS squares
            FROM rated r LEFT JOIN counts c ON c.doc_id = r.doc_id GROUP BY ALL)
        {' UNION ALL '.join(kappas)}"""

    # predictions
    sql["batch_score"] = f"SELECT doc_id, {scorer('length(text) + 4')} AS raw FROM documents"
    both = len(prompts.task_context("emotion_and_sentiment", True)) + 4
    sql["predict_combined"] = f"""SELECT doc_id, raw AS llama3_raw, {answered('raw')}, {answered_sentiment('raw')}
        FROM (SELECT doc_id, {scorer(f'length(text) + {both}')} AS raw FROM documents)"""
    sql["predict_separate"] = f"""SELECT doc_id, e AS llama3_emotion_raw, s AS llama3_sentiment_raw, {answered('e')}, {answered_sentiment('s')}
        FROM (SELECT doc_id, {scorer(role_length('emotion'))} AS e, {scorer(role_length('sentiment'))} AS s FROM documents)"""
    sql["merge_two_passes"] = f"WITH {RATED} SELECT doc_id, word AS emotion, substring AS sentiment FROM rated"
    sql["attach_predictions"] = f"WITH {RATED} SELECT doc_id, lang, word FROM rated"
    return sql
