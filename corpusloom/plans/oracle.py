"""SQL that gives the same rows as the queries of the catalogue, for another engine to check them."""

from __future__ import annotations

#: The expected values of this module are its own: nothing is taken over from the code it checks.
S = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
W = r"\p{L}\p{N}_"
EXCLUDED_SECTIONS = ["references", "bibliography", "appendix", "acknowledgments", "acknowledgements"]
TOPICS = [
    ("rag", "retrieval-augmented generation"),
    ("lora", "parameter-efficient fine-tuning"),
    ("qlora", "quantised fine-tuning"),
    ("hallucin", "LLM hallucination"),
    ("prompt", "prompt engineering"),
    ("instruct", "instruction tuning"),
]
PASSAGES, ASKED, REQUEST = "Passages:\n\n", "\n\n----\n\nQuestion: ", "\n\nGive an answer that rests on the passages alone."
REFERENCE_HEADINGS = [
    rf"\*\*[0-9]*\.?\*\*[{S}]*\*\*[Rr]eferences\*\*", rf"#+[{S}]*(?:[0-9]+\.?[{S}]+)?[Rr]eferences", r"\*\*[Rr]eferences\*\*", rf"[Rr]eferences[{S}]*$",
    rf"\*\*[0-9]*\.?\*\*[{S}]*\*\*[Bb]ibliography\*\*", rf"#+[{S}]*(?:[0-9]+\.?[{S}]+)?[Bb]ibliography", rf"\*\*[Aa]cknowledg[{W}]*\*\*",
]


def _bold(names: str, more: bool) -> str:
    return rf"\*\*[0-9]+\.?\*\*[{S}]*\*\*(?:{names})" + (f"[{W}]*" if more else "") + r"\*\*"


def _hash(names: str) -> str:
    return rf"#+[{S}]*(?:[0-9]+\.?[{S}]+)?(?:{names})"


#: The forms of each section's heading, the first that matches anywhere counts.
HEADINGS = {
    "abstract": [_bold("[Aa]bstract", False), _hash("[Aa]bstract"), r"\*\*[Aa]bstract\*\*", rf"Abstract[{S}]*$"],
    "introduction": [_bold("[Ii]ntroduction", False), _hash("[Ii]ntroduction")],
    "related_work": [_bold(rf"[Rr]elated[{S}]*[Ww]ork|[Bb]ackground|[Pp]reliminar", True), _hash(rf"[Rr]elated[{S}]*[Ww]ork|[Bb]ackground")],
    "method": [
        _bold("[Mm]ethod|[Aa]pproach|[Mm]odel|[Ff]ramework|[Ss]ystem|[Pp]roposed", True), _hash("[Mm]ethod|[Aa]pproach|[Mm]odel|[Ff]ramework"),
    ],
    "experiments": [_bold("[Ee]xperiment|[Ee]valuation|[Rr]esult|[Ss]etup", True), _hash("[Ee]xperiment|[Ee]valuation|[Rr]esult")],
    "discussion": [_bold("[Dd]iscussion|[Aa]nalysis|[Aa]blation", True), _hash("[Dd]iscussion|[Aa]nalysis|[Aa]blation")],
    "conclusion": [_bold("[Cc]onclusion|[Ss]ummary", True), _hash("[Cc]onclusion|[Ss]ummary")],
    "references": [_bold("[Rr]eferences|[Bb]ibliography", False), _hash("[Rr]eferences|[Bb]ibliography"), r"\*\*[Rr]eferences\*\*", rf"References[{S}]*$"],
    "acknowledgments": [_bold("[Aa]cknowledg", True), _hash("[Aa]cknowledg"), rf"\*\*[Aa]cknowledg[{W}]*\*\*"],
    "appendix": [_bold("[Aa]ppendix", True), _hash("[Aa]ppendix")],
}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sub(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {_q(pattern)}, {_q(by)}, 'g')"


def strip(text: str) -> str:
    return _sub(text, f"^[{S}]+|[{S}]+$")


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, {_q(f'[{S}]+')}), lambda w: w <> '')"


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {_q(pattern)}))"


def first(table: str, key: str, order: str) -> str:
    return f"(SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS _rn FROM {table}) WHERE _rn = 1)"


NL = "chr(10)"
CHUNKS = first("chunks", "chunk_id", "chunk_ord, chunked_at")
PARSED = first("papers_parsed", "arxiv_id", "parsed_at")
PAPERS = first("papers", "arxiv_id", "collected_at, coalesce(query_source, ''), coalesce(title, '')")
QA = first("qa_dataset", "qa_id", "created_at")


def digest(text: str) -> str:
    return f"length({text}) AS n_chars, md5({text}) AS digest"


def clean_text(text: str) -> str:
    t = _sub(text, r"!\[.*?\]\(.*?\)")
    return strip(_sub(f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')", " {2,}", " "))


def clean_chunk(text: str) -> str:
    t = _sub(text, r"!\[.*?\]\(.*?\)")
    t = _sub(t, r"\[([^\]]*)\]\(.*?\)", r"\1")
    t = _sub(t, f"(?m)^#+[{S}]*")
    t = _sub(t, r"\x{FFFD}")
    t = _sub(t, r"\|[^|\n]{0,30}\|[^|\n]{0,30}\|")
    t = _sub(t, r"\|Col[0-9]+")
    t = _sub(t, rf"(?m)^\|.*\|[{S}]*$")
    t = _sub(t, r"(?m)^[-|:]+$")
    t = _sub(t, rf"\[[{W}{S}]*\]")
    t = _sub(t, r"_([^_]{1,3})_")
    other = rf"[^\p{{L}}\p{{N}}{S}]"
    t = f"array_to_string(list_filter(string_split({t}, {NL}), lambda x: length(x) = 0 OR length({_sub('x', other)}) * 2 > length(x)), {NL})"
    return strip(_sub(f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')", " {2,}", " "))


def strip_references(text: str) -> str:
    head = "(?m:^(?:" + "|".join(REFERENCE_HEADINGS) + "))"
    pattern = _q(rf"(?s)\A(.*?){head}")
    return f"CASE WHEN regexp_matches({text}, {_q(head)}) THEN {strip(f'regexp_extract({text}, {pattern}, 1)')} ELSE {text} END"


DOI = r"https?://doi\.org|doi\.org|arxiv\.org"
FEATURES = f"""
    {count('text', DOI)} AS doi, {count('text', r'\b(?:19|20)[0-9]{2}\b')} AS year,
    {count('text', f'[A-Z][a-z]+[.,][{S}]*(?:19|20)[0-9]{{2}}')} AS author_year,
    {count('text', f'In[{S}]+_|In[{S}]+Proc|In[{S}]+[*]')} AS conf,
    {count('text', f'(?i){chr(92)}bpp{chr(92)}.[{S}]*[0-9]|pages?[{S}]*[0-9]')} AS page,
    len({words('text')}) AS n_words
"""
SCORE = "doi * 3 + author_year * 2 + conf * 2 + page * 2 + year"
CITATION = f"(n_words = 0 OR doi >= 2 OR conf >= 2 OR ({SCORE} > 8 AND n_words < 300) OR {SCORE} > 15)"


def quality(table: str, keys: str) -> str:
    return f"""SELECT {keys}, (n_words >= 30 AND alpha >= 0.6 * n_words AND NOT {CITATION}) AS is_quality
        FROM (SELECT *, {FEATURES}, len(list_filter({words('text')}, lambda w: regexp_matches(w, '\\p{{L}}'))) AS alpha FROM {table})"""


def _start(patterns: list[str]) -> str:
    """Position of the first match of the first pattern that matches, 0 without any."""
    cases = ""
    for p in patterns:
        cases += f" WHEN regexp_matches(t, {_q(f'(?m:^{p})')}) THEN length(regexp_extract(t, {_q(rf'(?s)\A(.*?)(?m:^{p})')}, 1)) + 1"
    return f"CASE{cases} ELSE 0 END"


EXCLUDED = ", ".join(map(_q, EXCLUDED_SECTIONS))
SECTIONS = f"""
    marks AS (
        SELECT * FROM (
            {" UNION ALL ".join(f"SELECT arxiv_id, t, {_q(name)} AS section, {_start(p)} AS start_at FROM texts" for name, p in HEADINGS.items())}
        ) WHERE start_at > 0
    ), bodies AS (
        SELECT arxiv_id, section, start_at, {strip("substring(t, start_at, coalesce(lead(start_at) OVER (PARTITION BY arxiv_id ORDER BY start_at, section), length(t) + 1) - start_at)")} AS body
        FROM marks
    ), long AS (SELECT * FROM bodies WHERE length(body) > 50
    ), good AS (SELECT arxiv_id FROM long GROUP BY arxiv_id HAVING bool_or(section NOT IN ({EXCLUDED}))
    ), sections AS (
        SELECT arxiv_id, row_number() OVER (PARTITION BY arxiv_id ORDER BY start_at, section) - 1 AS pos, section, body FROM long SEMI JOIN good USING (arxiv_id)
        UNION ALL SELECT arxiv_id, 0, 'full_text', t FROM texts ANTI JOIN good USING (arxiv_id)
    )
"""
TEXTS = f"texts AS (SELECT arxiv_id, full_text AS t FROM {PARSED} WHERE full_text IS NOT NULL)"

CONTENT = f"""
    content AS (
        SELECT * FROM (
            SELECT arxiv_id, 'full_text' AS section, {strip_references("coalesce(full_text, '')")} AS body FROM {PARSED}
            WHERE sections IS NULL OR cardinality(sections) = 0 OR map_contains(sections, 'full_text')
            UNION ALL
            SELECT arxiv_id, e.key, e.value FROM (
                SELECT arxiv_id, unnest(map_entries(sections)) AS e FROM {PARSED}
                WHERE NOT (sections IS NULL OR cardinality(sections) = 0 OR map_contains(sections, 'full_text'))
            )
        ) WHERE lower(section) NOT IN ({EXCLUDED}) AND coalesce(body, '') <> ''
    )
"""
#: Windows of ``body`` in table ``src``; ``keys`` come along.
WINDOWS = """
    SELECT {keys}, CASE WHEN len(w) <= 450 THEN [{{'idx': 0, 'start': 0, 'text': body, 'n': len(w)}}] ELSE
        list_transform(
            list_zip(generate_series(0, 10000)[1:len(kept)], kept),
            lambda z: {{'idx': CAST(z[1] AS BIGINT), 'start': CAST(z[2]['start'] AS BIGINT), 'text': z[2]['text'], 'n': CAST(z[2]['n'] AS BIGINT)}})
        END AS win
    FROM (
        SELECT *, list_filter(list_transform(generate_series(0, (greatest(len(w), 1) - 1) // 386),
            lambda i: {{'start': i * 386, 'text': array_to_string(list_slice(w, i * 386 + 1, i * 386 + 450), ' '), 'n': len(list_slice(w, i * 386 + 1, i * 386 + 450))}}),
            lambda x: x['n'] >= 10) AS kept
        FROM (SELECT *, {words} AS w FROM {src})
    )
"""
RECORDS = f"""
    {CONTENT}, cleaned AS (SELECT arxiv_id, section, {clean_chunk('body')} AS body FROM content),
    long_enough AS (SELECT * FROM cleaned WHERE len({words('body')}) >= 20),
    cut AS ({WINDOWS.format(keys="arxiv_id, section", words=words("body"), src="long_enough")}),
    flat AS (SELECT arxiv_id, section, len(win) AS total_in_section, unnest(win) AS x FROM cut),
    pieces AS (SELECT arxiv_id, section, total_in_section, x['idx'] AS chunk_index, x['text'] AS text, x['n'] AS n FROM flat),
    judged AS ({quality("pieces", "*")}),
    records AS (SELECT *, substring(md5(concat_ws(':', arxiv_id, section, chunk_index)), 1, 12) AS chunk_id FROM judged WHERE is_quality)
"""

TOKENS = f"list_filter(string_split_regex({_sub('lower(text)', f'[^a-z0-9{S}-]', ' ')}, {_q(f'[{S}]+')}), lambda w: length(w) > 1)"
Q_TOKENS = TOKENS.replace("lower(text)", "lower(question)")
BM25 = f"""
    corpus AS (SELECT doc_id AS doc, text, arxiv_id, section, source AS title FROM documents WHERE text IS NOT NULL),
    tokens AS (SELECT doc, {TOKENS} AS t FROM corpus),
    lengths AS (SELECT doc, len(t) AS dl FROM tokens),
    postings AS (SELECT term, doc, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM tokens) GROUP BY term, doc),
    raw AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM lengths) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM postings GROUP BY term),
    terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)
"""
QUESTIONS = """
    questions AS (
        SELECT item_id AS query_id, question, embedding FROM eval_details JOIN embeddings ON vec_id = item_id WHERE item_id % 50 = 0
    )
"""
LEXICAL = f"""
    {BM25}, {QUESTIONS},
    asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({Q_TOKENS}) AS term FROM questions) GROUP BY ALL),
    lexical_scores AS (
        SELECT query_id, doc, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM lengths)))), 9) AS score
        FROM asked JOIN postings USING (term) JOIN terms USING (term) JOIN lengths USING (doc) GROUP BY query_id, doc
    ),
    lexical AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM lexical_scores WHERE score > 0)
        WHERE rank <= 40
    )
"""
DISTANCE = "round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6)"
DENSE = f"""
    dense AS (
        SELECT * FROM (
            SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc) AS rank
            FROM (SELECT q.query_id, e.vec_id AS doc, {DISTANCE} AS distance FROM questions q CROSS JOIN embeddings e)
        ) WHERE rank <= 40
    )
"""
FUSED = f"""
    {LEXICAL}, {DENSE},
    fused_all AS (
        SELECT query_id, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf
        FROM (SELECT query_id, doc, rank FROM dense UNION ALL SELECT query_id, doc, rank FROM lexical) GROUP BY query_id, doc
    ),
    fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc) AS rank FROM fused_all) WHERE rank <= 40)
"""


def dedup(ranked: str, groups: str, columns: str) -> str:
    return f"""(SELECT * FROM (
        SELECT query_id, doc, arxiv_id, section, {columns}, row_number() OVER (PARTITION BY query_id ORDER BY old) AS rank FROM (
            SELECT r.query_id, r.doc, c.arxiv_id, c.section, {columns}, r.rank AS old,
                row_number() OVER (PARTITION BY r.query_id, {groups} ORDER BY r.rank) AS n
            FROM {ranked} r JOIN corpus c USING (doc)
        ) WHERE n = 1
    ) WHERE rank <= 5)"""


HYBRID = f"{FUSED}, found AS {dedup('fused', 'c.arxiv_id, c.section', 'rrf')}"
HEAD = f"array_to_string(list_slice({words('text')}, 1, 200), ' ')"
RERANKED = f"""
    {FUSED},
    pairs AS (
        SELECT query_id, doc, f.rank AS old, list_distinct({Q_TOKENS}) AS qt, {TOKENS.replace('lower(text)', f'lower({HEAD})')} AS tt
        FROM fused f JOIN corpus c USING (doc) JOIN questions USING (query_id)
    ),
    rescored AS (
        SELECT query_id, doc, old, round(coalesce(len(list_intersect(qt, tt))::DOUBLE / nullif(len(qt), 0), 0), 9) AS score FROM pairs
    ),
    reranked AS (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS rank FROM rescored),
    found AS {dedup('reranked', 'c.arxiv_id, c.section', 'score')}
"""
CONTEXT = """
    context AS (
        SELECT query_id, string_agg('[' || rank || '] Paper: ' || coalesce(title, '') || chr(10) || '    Section: ' || coalesce(c.section, '') || chr(10)
            || '    Content: ' || coalesce(text, '') || chr(10), chr(10) ORDER BY rank) AS context
        FROM found f JOIN corpus c USING (doc) GROUP BY query_id
    )
"""
TOPIC = "CASE" + "".join(f" WHEN contains(lower(coalesce(title, '')), {_q(k)}) THEN {_q(v)}" for k, v in TOPICS) + " ELSE 'machine learning' END"
ALLOCATED = f"""
    eligible AS (
        SELECT *, row_number() OVER (ORDER BY md5('42:' || chunk_id)) - 1 AS place, count(*) OVER () AS n FROM {CHUNKS} WHERE word_count >= 80
    ),
    sized AS (SELECT *, CAST(floor(least(n, 2000) * 0.6) AS BIGINT) AS g, CAST(floor(least(n, 2000) * 0.2) AS BIGINT) AS s FROM eligible),
    placed AS (
        SELECT *, least(n, 2000) - g - s AS r, CASE WHEN place < g THEN 'grounded' WHEN place < g + (least(n, 2000) - g - s) THEN 'refusal' ELSE 'synthesis' END AS kind
        FROM sized
    ),
    pool AS (SELECT *, place - g - r AS pool_place FROM placed WHERE kind = 'synthesis'),
    pairs AS (
        SELECT a.pool_place // 2 AS pair_no, a.chunk_id AS first, b.chunk_id AS second, a.arxiv_id AS paper_a, b.arxiv_id AS paper_b
        FROM pool a JOIN pool b ON b.pool_place = a.pool_place + 1
        WHERE a.pool_place % 2 = 0 AND b.pool_place < 2 * a.s AND a.arxiv_id <> b.arxiv_id
    )
"""


def passage(prefix: str, chars: int) -> str:
    return f"'Context from ''' || coalesce({prefix}title, '') || ''' (' || coalesce({prefix}section, '') || '):' || chr(10) || substring({prefix}text, 1, {chars})"


RULES = "Stay with what the excerpt says, name the paper, write plain sentences, and reply with one JSON object that has the keys question and answer only."
GROUNDED = "Write a question about one claim, method or result of this excerpt, and its answer in two to four sentences.\n" + RULES + "\n\nPaper: "
SYNTHESIS = "Write a question that compares these two papers, and an answer in three to five sentences that uses both.\n" + RULES
REFUSAL = (
    "Write a question on the topic of this paper that the excerpt does not answer, and an answer that says what the excerpt covers and what it lacks.\n"
    + RULES + "\n\nPaper: "
)
EXCERPT = "chr(10) || 'Excerpt:' || chr(10) || substring({}text, 1, {})"
REQUESTS = f"""
    {ALLOCATED}, requests AS (
        SELECT chunk_id AS sample, kind AS type, CASE WHEN kind = 'grounded'
                THEN {_q(GROUNDED)} || coalesce(title, '') || {EXCERPT.format('', 500)}
                ELSE {_q(REFUSAL)} || coalesce(title, '') || chr(10) || 'Topic: ' || {TOPIC} || {EXCERPT.format('', 500)} END AS prompt,
            {passage('', 500)} AS context, arxiv_id AS source_arxiv_id
        FROM placed WHERE kind <> 'synthesis'
        UNION ALL
        SELECT 'pair-' || pair_no, 'synthesis', {_q(SYNTHESIS)} || chr(10) || chr(10) || 'Paper 1: ' || coalesce(a.title, '') || {EXCERPT.format('a.', 400)}
            || chr(10) || chr(10) || 'Paper 2: ' || coalesce(b.title, '') || {EXCERPT.format('b.', 400)},
            {passage('a.', 400)} || chr(10) || chr(10) || {passage('b.', 400)}, paper_a || ',' || paper_b
        FROM pairs JOIN {CHUNKS} a ON a.chunk_id = first JOIN {CHUNKS} b ON b.chunk_id = second
    )
"""
INSTRUCTION = (
    "You answer research questions from the passages below only. Name the paper behind each point, and say so when the passages are not enough."
)
SAMPLES = f"""
    {REQUESTS}, samples AS (
        SELECT sample, type, {_q(INSTRUCTION)} AS instruction, context || chr(10) || chr(10) || 'Question: What does text ' || md5(prompt) || ' say?' AS input,
            'Text ' || md5(prompt) || ' has ' || length(prompt) || ' characters.' AS output, source_arxiv_id, md5('42:' || sample) AS order_key
        FROM requests WHERE prompt IS NOT NULL
    )
"""

RANKED_LISTS = """
    lists AS (SELECT item_id, source_ids AS found, list_transform(source_ids, lambda x, i: CASE WHEN list_contains(expected_ids, x) THEN i END) AS ranks FROM eval_details),
    scored AS (
        SELECT item_id, len(good) > 0 AS hit, coalesce(1.0::DOUBLE / list_min(good), 0) AS rr, coalesce(len(good)::DOUBLE / nullif(len(found), 0), 0) AS precision
        FROM (SELECT *, list_filter(ranks, lambda r: r IS NOT NULL) AS good FROM lists)
    )
"""

ORACLE: dict[str, str] = {
    "paper_dedup_keep_first": f"SELECT arxiv_id, title, query_source, primary_category FROM {PAPERS}",
    "resume_union_antijoin": f"""
        WITH known AS (SELECT arxiv_id, title FROM {PARSED})
        SELECT * FROM known UNION ALL
        SELECT arxiv_id, title FROM {first("papers", "arxiv_id", "collected_at, coalesce(title, '')")} WHERE arxiv_id NOT IN (SELECT arxiv_id FROM known)
    """,
    "usable_papers": """
        SELECT DISTINCT arxiv_id, local_pdf_path FROM papers WHERE local_pdf_path IS NOT NULL AND local_pdf_path <> ''
        AND arxiv_id IN (SELECT arxiv_id FROM papers_parsed WHERE full_text IS NOT NULL AND full_text <> '')
    """,
    "pending_downloads": """
        SELECT DISTINCT arxiv_id, replace(arxiv_id, '/', '_') || '.pdf' AS file_name FROM papers
        WHERE replace(arxiv_id, '/', '_') || '.pdf' NOT IN (SELECT string_split(local_pdf_path, '/')[-1] FROM papers WHERE local_pdf_path <> '')
    """,
    "paper_record": f"""
        SELECT DISTINCT arxiv_id, string_split(pdf_url, '/')[-1] AS short_id, replace(string_split(pdf_url, '/')[-1], '/', '_') || '.pdf' AS file_name,
            array_to_string(list_slice(authors, 1, 3), ', ') AS first_authors, substring(title, 1, 50) AS title_preview,
            'https://preprints.example/abs/' || arxiv_id AS abs_url, strftime(collected_at, '%Y-%m-%dT%H:%M:%S') AS collected_iso
        FROM {PAPERS}
    """,
    "word_char_counts": f"""
        SELECT DISTINCT arxiv_id, coalesce(length(full_text), 0) AS chars, coalesce(len({words('full_text')}), 0) AS words,
            coalesce(char_count, -1) AS stored_chars, coalesce(word_count, -1) AS stored_words FROM papers_parsed
    """,
    "defaults_and_iso": f"""
        SELECT arxiv_id, coalesce(nullif({strip('abstract')}, ''), title, '') AS summary, coalesce(local_pdf_path, '') AS path,
            strftime(CAST(published AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS published_utc FROM {PAPERS}
    """,
    "text_clean": f"SELECT arxiv_id, {digest('t')} FROM (SELECT arxiv_id, {clean_text('full_text')} AS t FROM {PARSED})",
    "chunk_text_clean": f"SELECT chunk_id, {digest('t')} FROM (SELECT chunk_id, {clean_chunk('text')} AS t FROM {CHUNKS})",
    "strip_references": f"SELECT arxiv_id, {digest('t')} FROM (SELECT arxiv_id, {strip_references('full_text')} AS t FROM {PARSED})",
    "citation_filter": f"""
        SELECT doc_id, doi, year, author_year, conf, page, n_words, {SCORE} AS score, {CITATION} AS is_citation
        FROM (SELECT doc_id, {FEATURES} FROM documents WHERE text IS NOT NULL)
    """,
    "quality_filter": quality(f"(SELECT chunk_id, text FROM {CHUNKS} WHERE text IS NOT NULL)", "chunk_id"),
    "section_split": f"WITH {TEXTS}, {SECTIONS} SELECT arxiv_id, pos, section, {digest('body')} FROM sections",
    "section_stats": f"""
        WITH {TEXTS}, {SECTIONS}, per AS (SELECT arxiv_id, bool_or(section = 'full_text') AS bare, count(*) AS n FROM sections GROUP BY arxiv_id)
        SELECT count_if(bare) AS full_text_papers, count_if(NOT bare) AS sectioned_papers, CAST(sum(n) AS BIGINT) AS n_sections FROM per
    """,
    "content_sections": f"WITH {CONTENT} SELECT arxiv_id, section, {digest('body')} FROM content",
    "chunk_windows": f"""
        WITH src AS (SELECT doc_id, text AS body FROM documents WHERE text IS NOT NULL),
        cut AS ({WINDOWS.format(keys="doc_id", words=words("body"), src="src")})
        SELECT doc_id, x['idx'] AS idx, x['start'] AS start_word, x['n'] AS n_words, md5(x['text']) AS digest FROM (SELECT doc_id, unnest(win) AS x FROM cut)
    """,
    "chunk_records": f"WITH {RECORDS} SELECT arxiv_id, section, chunk_index, total_in_section, chunk_id, n AS n_words, md5(text) AS digest FROM records",
    "chunk_skipped_papers": f"WITH {RECORDS} SELECT arxiv_id FROM {PARSED} WHERE arxiv_id NOT IN (SELECT arxiv_id FROM records)",
    "index_metadata": f"""
        SELECT chunk_id, arxiv_id, coalesce(title, '') AS title, coalesce(section, '') AS section,
            coalesce(array_to_string(list_slice(metadata.authors, 1, 3), ', '), '') AS authors, coalesce(metadata.published, '') AS published,
            (row_number() OVER (ORDER BY chunk_ord, chunk_id) - 1) // 32 AS batch_no
        FROM {CHUNKS} WHERE length({strip('text')}) > 10
    """,
    "index_counters": f"""
        SELECT CASE WHEN text IS NULL THEN 'null' WHEN length({strip('text')}) <= 10 THEN 'skipped' ELSE 'indexed' END AS status, count(*) AS n
        FROM {CHUNKS} GROUP BY 1
    """,
    "bm25_tokens": f"WITH {BM25} SELECT doc, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM tokens",
    "bm25_stats": f"""
        WITH {BM25} SELECT (SELECT count(*) FROM lengths) AS n_docs, (SELECT round(avg(dl), 6) FROM lengths) AS avgdl,
            count(*) AS n_terms, round(avg(idf), 6) AS mean_idf, CAST(sum(df) AS BIGINT) AS sum_df FROM terms
    """,
    "bm25_terms": f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "bm25_topk": f"WITH {LEXICAL} SELECT query_id, doc, round(score, 6) AS score, rank FROM lexical",
    "vector_topk": f"""
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank
            FROM (SELECT q.vec_id AS query_id, e.vec_id, {DISTANCE} AS distance FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 50 = 0)
        ) WHERE rank <= 10
    """,
    "cosine_contrast": """
        WITH cells AS (
            SELECT label, unnest(generate_series(1, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label IS NOT NULL
        ), labels AS (SELECT DISTINCT label FROM cells),
        own AS (SELECT label, i, avg(x) AS x FROM cells GROUP BY label, i),
        other AS (SELECT l.label, c.i, avg(c.x) AS x FROM labels l JOIN cells c ON c.label <> l.label GROUP BY l.label, c.i),
        means AS (SELECT own.label, list(own.x ORDER BY i) AS mean, list(other.x ORDER BY i) AS rest FROM own JOIN other USING (label, i) GROUP BY own.label),
        found AS (
            SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), mean) AS same, list_cosine_similarity(CAST(embedding AS DOUBLE[]), rest) AS other
            FROM embeddings JOIN means USING (label)
        )
        SELECT vec_id, round(same, 6) AS same_label, round(other, 6) AS other_label, same > other AS is_nearer FROM found
    """,
    "rrf_fusion": f"WITH {FUSED} SELECT query_id, doc, round(rrf, 6) AS rrf, rank FROM fused",
    "hybrid_search_top5": f"WITH {HYBRID} SELECT query_id, doc, arxiv_id, section, round(rrf, 6) AS score, rank FROM found",
    "dedup_paper_topk": f"WITH {FUSED}, found AS {dedup('fused', 'c.arxiv_id', 'rrf')} SELECT query_id, doc, arxiv_id, round(rrf, 6) AS score, rank FROM found",
    "lexical_search_top5": f"""
        WITH {LEXICAL} SELECT query_id, doc, round(1.0::DOUBLE / (60 + rank), 6) AS score, rank FROM lexical WHERE rank <= 5
    """,
    "rerank_lexical": f"""
        WITH {RERANKED} SELECT query_id, doc, round(score, 6) AS score, round(1 - 1 / (1 + exp(-score)), 6) AS distance,
            round(greatest(0, (1 - (1 - 1 / (1 + exp(-score)))) * 100), 6) AS relevance, rank FROM found
    """,
    "sigmoid_distance": """
        SELECT event_id, round(1 - 1 / (1 + exp(-s)), 6) AS distance, round(greatest(0, (1 - (1 - 1 / (1 + exp(-s)))) * 100), 6) AS relevance
        FROM (SELECT event_id, (value - 50) / 25 AS s FROM events)
    """,
    "context_prompt": f"WITH {HYBRID}, {CONTEXT} SELECT query_id, length(context) AS n_chars, md5(context) AS digest FROM context",
    "sources_dedup": f"""
        WITH {HYBRID} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY f.rank) AS pos, c.arxiv_id, c.section, c.title
        FROM found f JOIN corpus c USING (doc)
    """,
    "rag_prompt_batch": f"""
        WITH {HYBRID}, {CONTEXT}, prompts AS (
            SELECT query_id, {_q(PASSAGES)} || context || {_q(ASKED)} || question || {_q(REQUEST)} AS p FROM context JOIN questions USING (query_id)
        ) SELECT query_id, length(p) AS n_chars, md5(p) AS digest FROM prompts
    """,
    "think_strip": f"""
        WITH raw AS (SELECT qa_id, '<think>first' || chr(10) || 'thoughts</think>' || output || '<think>cut' AS raw, output FROM {QA} WHERE output IS NOT NULL)
        SELECT qa_id, md5({strip(_sub(_sub('raw', '(?s)<think>.*?</think>'), '(?s)<think>.*'))}) AS digest,
            md5({strip(_sub(_sub('output', '(?s)<think>.*?</think>'), '(?s)<think>.*'))}) AS own_digest FROM raw
    """,
    "json_extract_valid": f"""
        WITH made AS (SELECT qa_id, regexp_extract(input, '(?s)Question: (.*)$', 1) AS q, output AS a FROM {QA} WHERE input IS NOT NULL AND output IS NOT NULL),
        raw AS (SELECT qa_id, 'Sure: ' || to_json({{'question': q, 'answer': a}}) || ' done' AS raw FROM made),
        cut AS (SELECT qa_id, substring(raw, strpos(raw, '{{'), length(raw) - strpos(reverse(raw), '}}') + 2 - strpos(raw, '{{')) AS j FROM raw),
        parsed AS (SELECT qa_id, j->>'question' AS q, j->>'answer' AS a FROM cut)
        SELECT qa_id, length(q) > 10 AND length(a) > 20 AS valid, CASE WHEN length(q) > 10 AND length(a) > 20 THEN length(q) END AS n_question,
            CASE WHEN length(q) > 10 AND length(a) > 20 THEN length(a) END AS n_answer FROM parsed
    """,
    "group_chunks_by_paper": f"""
        SELECT arxiv_id, first_value(title) OVER w AS title, count(*) OVER (PARTITION BY arxiv_id) AS n_chunks,
            row_number() OVER w - 1 AS pos, chunk_id FROM {CHUNKS} WINDOW w AS (PARTITION BY arxiv_id ORDER BY chunk_ord, chunk_id)
    """,
    "qa_sample_allocation": f"WITH {ALLOCATED} SELECT chunk_id, place, kind FROM placed",
    "qa_pairs": f"WITH {ALLOCATED} SELECT pair_no, first, second FROM pairs",
    "qa_topic_case": f"SELECT arxiv_id, {TOPIC} AS topic FROM {PAPERS}",
    "qa_inputs": f"WITH {ALLOCATED} SELECT chunk_id, kind, {TOPIC} AS topic, md5({passage('', 500)}) AS digest FROM placed WHERE kind <> 'synthesis'",
    "qa_synthesis_inputs": f"""
        WITH {ALLOCATED} SELECT pair_no, paper_a || ',' || paper_b AS source_arxiv_id,
            md5({passage('a.', 400)} || chr(10) || chr(10) || {passage('b.', 400)}) AS digest
        FROM pairs JOIN {CHUNKS} a ON a.chunk_id = first JOIN {CHUNKS} b ON b.chunk_id = second
    """,
    "qa_dataset_union": f"""
        WITH {ALLOCATED}, made AS (
            SELECT kind, chunk_id AS sample, arxiv_id AS source FROM placed WHERE kind <> 'synthesis'
            UNION ALL SELECT 'synthesis', 'pair-' || pair_no, paper_a || ',' || paper_b FROM pairs
        ) SELECT *, md5('42:' || sample) AS order_key FROM made
    """,
    "qa_requests": f"WITH {REQUESTS} SELECT sample, type, md5(prompt) AS prompt_digest, md5(context) AS context_digest, source_arxiv_id FROM requests",
    "qa_samples": f"WITH {SAMPLES} SELECT sample, type, instruction, md5(input) AS input_digest, output, source_arxiv_id, order_key FROM samples",
    "qa_sample_stats": f"""
        WITH {SAMPLES} SELECT count(*) AS total, count_if(type = 'grounded') AS type1_grounded, count_if(type = 'synthesis') AS type2_synthesis,
            count_if(type = 'refusal') AS type3_refusal FROM samples
    """,
    "qa_type_counts": f"SELECT coalesce(lower({strip('type')}), 'unknown') AS type, count(*) AS n FROM {QA} GROUP BY 1",
    "chat_messages": f"""
        SELECT qa_id, CASE WHEN instruction IS NULL THEN 2 ELSE 3 END AS n_messages,
            md5(coalesce('system: ' || instruction || chr(10), '') || 'user: ' || input || chr(10) || 'assistant: ' || output) AS digest
        FROM {QA} WHERE input IS NOT NULL AND output IS NOT NULL
    """,
    "token_length_stats": f"""
        WITH n AS (SELECT len({words("concat_ws(' ', instruction, input, output)")}) AS n FROM {QA})
        SELECT min(n) AS n_min, max(n) AS n_max, round(avg(n), 6) AS n_mean, count_if(n > 200) AS n_over,
            round(count_if(n > 200) * 100.0::DOUBLE / count(*), 6) AS pct_over FROM n
    """,
    "train_eval_split": f"""
        SELECT qa_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || qa_id)) <= ceil(round(0.05 * count(*) OVER (), 6)) THEN 'eval' ELSE 'train' END AS split
        FROM {QA}
    """,
    "retrieval_metrics": f"""
        WITH {RANKED_LISTS} SELECT round(avg(hit::INT::DOUBLE), 6) AS hit_rate, round(avg(rr), 6) AS mrr, round(avg(precision), 6) AS avg_precision,
            count(*) AS total_questions FROM scored
    """,
    "retrieval_metrics_vectors": f"""
        WITH ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
                SELECT q.vec_id AS query_id, q.label AS own, e.vec_id, e.label, {DISTANCE} AS distance FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 50 = 0)
        ), found AS (SELECT *, own = label AS rel FROM ranked WHERE rank <= 6 AND vec_id <> query_id),
        scored AS (
            SELECT query_id, bool_or(rel) AS hit, coalesce(1.0::DOUBLE / min(CASE WHEN rel THEN rank END), 0) AS rr, avg(rel::INT::DOUBLE) AS precision
            FROM found GROUP BY query_id
        ) SELECT round(avg(hit::INT::DOUBLE), 6) AS hit_rate, round(avg(rr), 6) AS mrr, round(avg(precision), 6) AS avg_precision, count(*) AS total_questions
        FROM scored
    """,
    "answer_details": f"""
        WITH k AS (SELECT item_id, coalesce(answer, '') AS a, list_distinct({Q_TOKENS}) AS keywords FROM eval_details),
        s AS (SELECT item_id, len({words('a')}) AS words, len(list_filter(keywords, lambda x: contains(lower(a), x))) AS found, len(keywords) AS total, a FROM k)
        SELECT item_id, words, found, total, round(found::DOUBLE / nullif(total, 0), 6) AS coverage, words > 20 AND NOT contains(lower(a), 'i don''t') AS substantive
        FROM s
    """,
    "answer_metrics": """
        SELECT round(avg(keyword_coverage), 6) AS avg_keyword_coverage, round(avg(source_hit::INT::DOUBLE), 6) AS source_hit_rate,
            round(avg(is_substantive::INT::DOUBLE), 6) AS substantive_rate, round(avg(answer_word_count::DOUBLE), 6) AS avg_word_count,
            round(avg(latency_seconds), 6) AS avg_latency, round(sum(latency_seconds), 2) AS total_time, count(*) AS total_questions FROM eval_details
    """,
    "eval_report_details": f"WITH {RANKED_LISTS} SELECT item_id, hit, round(rr, 6) AS rr, round(precision, 6) AS precision FROM scored",
    "eval_report": f"""
        WITH {RANKED_LISTS} SELECT 'baseline' AS label, 5 AS top_k, count(*) AS dataset_size, round(avg(hit::INT::DOUBLE), 6) AS hit_rate, round(avg(rr), 6) AS mrr,
            round(avg(precision), 6) AS avg_precision, (SELECT round(avg(keyword_coverage), 6) FROM eval_details) AS avg_keyword_coverage,
            (SELECT round(avg(source_hit::INT::DOUBLE), 6) FROM eval_details) AS source_hit_rate,
            (SELECT round(avg(is_substantive::INT::DOUBLE), 6) FROM eval_details) AS substantive_rate,
            (SELECT round(sum(latency_seconds), 2) FROM eval_details) AS total_time, count(*) AS n_details,
            printf('%.2f%%', round(avg(hit::INT::DOUBLE) * 100, 2)) AS hit_rate_text,
            (SELECT printf('%.2f%%', round(avg(keyword_coverage) * 100, 2)) FROM eval_details) AS coverage_text FROM scored
    """,
    "run_progress": """
        WITH run AS (
            SELECT item_id, sum(coalesce(latency_seconds, 0)) OVER (ORDER BY item_id) AS seconds, row_number() OVER (ORDER BY item_id) AS done, count(*) OVER () AS n
            FROM eval_details
        ) SELECT item_id, round(done * 60 / nullif(seconds, 0), 6) AS per_minute, round((n - done) / nullif(done * 60 / nullif(seconds, 0), 0), 6) AS minutes_left FROM run
    """,
}
