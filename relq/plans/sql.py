"""DuckDB SQL building blocks for the oracle side of the registered queries.

Each block is a CTE text; queries are assembled as ``WITH a AS (...), b AS (...) SELECT``.
The fixed values come from ``relq.templates`` so the two sides cannot drift.
"""

from __future__ import annotations

from relq.functions.text import PY_WHITESPACE, RELEVANT_RE
from relq.operators.tokens import PIECE_RE
from relq.plans.answers import DAMAGE_ONE_IN, N_CLASSES, SILENT_ONE_IN
from relq.templates import (CHATML, DEFAULT_SEED, INSTRUCTIONS, LABEL_TO_QUERIES, LABEL_TO_TOPIC, LANG_LABELS,
                            MAX_TOKENS, NEG_REASONS, NUM_LABELS, POS_REASONS, PROMPT_VARIANTS, SUMMARY_MATCH,
                            SUMMARY_NO_MATCH, SUMMARY_PREFIX)

SEED = DEFAULT_SEED
NL = "chr(10)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lit_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def pick(key: str, purpose: str, n: int, seed: int = SEED) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {key}, '{purpose}')), 1, 8))::BIGINT % {n})"


def hash_hex(seed: int, *parts: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(parts)}))"


WS = " || ".join(f"chr({c})" for c in PY_WHITESPACE)


def py_strip(x: str) -> str:
    return f"trim({x}, {WS})"


TOPICS = lit_list([LABEL_TO_TOPIC[i] for i in range(NUM_LABELS)])
QUERIES = "[" + ", ".join(lit_list(LABEL_TO_QUERIES[i]) for i in range(NUM_LABELS)) + "]"
INSTR = lit_list(INSTRUCTIONS)
POSR = lit_list([POS_REASONS[i] for i in range(NUM_LABELS)])
NEGR = lit_list([NEG_REASONS[i] for i in range(NUM_LABELS)])

CORPUS = ("SELECT doc_id, text, CASE lang " + " ".join(f"WHEN {lit(l)} THEN {i}" for i, l in enumerate(LANG_LABELS))
          + " END::INTEGER AS label FROM documents WHERE lang IN (" + ", ".join(lit(l) for l in LANG_LABELS) + ")")

NEG = f"""SELECT c.doc_id, l.l AS neg_label
  FROM corpus c JOIN (SELECT unnest(range(0, {NUM_LABELS}))::INTEGER AS l) l ON l.l <> c.label
  QUALIFY row_number() OVER (PARTITION BY c.doc_id ORDER BY {hash_hex(SEED, 'c.doc_id', "'neg'", 'l.l')}, l.l) = 1"""

SROWS = """SELECT doc_id, text, label, 0 AS slot, label AS query_label, true AS relevant FROM corpus
  UNION ALL
  SELECT c.doc_id, c.text, c.label, 1 AS slot, n.neg_label AS query_label, false AS relevant
  FROM corpus c JOIN neg n USING (doc_id)"""


def _samples_select(version: int) -> str:
    instr = f"{INSTR}[{pick('sample_id', 'instruction', len(INSTRUCTIONS))} + 1]"
    query = f"{QUERIES}[query_label + 1][{pick('sample_id', 'query', 6)} + 1]"
    if version == 2:
        out = (f"""'{{"relevant": ' || CASE WHEN relevant THEN 'true' ELSE 'false' END || ', "reason": {{"query_topic": "' """
               f"""|| {TOPICS}[query_label + 1] || '", "document_topic": "' || {TOPICS}[label + 1] || '", "summary": "' """
               f"""|| {lit(SUMMARY_PREFIX)} || {TOPICS}[label + 1] || CASE WHEN relevant THEN {lit(SUMMARY_MATCH)} """
               f"""ELSE {lit(SUMMARY_NO_MATCH)} END || '"}}}}'""")
    else:
        out = (f"""'{{"relevant": ' || CASE WHEN relevant THEN 'true' ELSE 'false' END || ', "reason": "' """
               f"""|| CASE WHEN relevant THEN {POSR}[label + 1] ELSE {NEGR}[query_label + 1] END || '"}}'""")
    return f"""SELECT sample_id, doc_id, slot, relevant, label, query_label, {instr} AS instruction,
    'Query: ' || {query} || {NL} || 'Document: ' || text AS input, {out} AS output
  FROM (SELECT *, doc_id * 2 + slot AS sample_id FROM srows)"""


def samples_ctes(version: int = 2) -> list[tuple[str, str]]:
    return [("corpus", CORPUS), ("neg", NEG), ("srows", SROWS), ("samples", _samples_select(version))]


_DAMAGE = pick("sample_id", "damage", DAMAGE_ONE_IN)
EVAL_SAMPLES = f"""SELECT * REPLACE (
    CASE WHEN {_DAMAGE} = 0 THEN replace(input, {NL} || 'Document:', ' Document ') ELSE input END AS input,
    CASE {_DAMAGE} WHEN 1 THEN substr(output, 1, length(output) - 5) WHEN 2 THEN output || ' x' ELSE output END AS output) FROM samples"""

GOLD = f"""SELECT sample_id, instruction, query, document, relevant, gold_query_topic, gold_document_topic, gold_summary FROM (
  SELECT sample_id, instruction,
    {py_strip("replace(substr(input, 1, cut - 1), 'Query:', '')")} AS query,
    {py_strip("substr(input, cut + 10)")} AS document,
    CASE WHEN json_type(json_extract(jo, '$.relevant')) = 'BOOLEAN' THEN json_extract(jo, '$.relevant')::VARCHAR = 'true' END AS relevant,
    CASE WHEN json_type(json_extract(jo, '$.reason.query_topic')) = 'VARCHAR' THEN json_extract_string(jo, '$.reason.query_topic') END AS gold_query_topic,
    CASE WHEN json_type(json_extract(jo, '$.reason.document_topic')) = 'VARCHAR' THEN json_extract_string(jo, '$.reason.document_topic') END AS gold_document_topic,
    CASE WHEN json_type(json_extract(jo, '$.reason.summary')) = 'VARCHAR' THEN json_extract_string(jo, '$.reason.summary') END AS gold_summary
  FROM (SELECT *, strpos(input, {NL} || 'Document:') AS cut,
               CASE WHEN json_valid(output) THEN output END AS jo FROM ({EVAL_SAMPLES})) WHERE cut > 0
    AND json_type(json_extract(jo, '$.reason')) = 'OBJECT'
    AND list_has_all(json_keys(json_extract(jo, '$.reason')), ['query_topic', 'document_topic', 'summary'])
) WHERE relevant IS NOT NULL"""

GOLD_FLAGS = f"""SELECT sample_id, gold FROM (
  SELECT sample_id, CASE WHEN json_type(json_extract(jo, '$.relevant')) = 'BOOLEAN'
                         THEN json_extract(jo, '$.relevant')::VARCHAR = 'true' END AS gold
  FROM (SELECT sample_id, CASE WHEN json_valid(output) THEN output END AS jo FROM ({EVAL_SAMPLES}))) WHERE gold IS NOT NULL"""


def _answer_sql(silent: bool = True) -> str:
    g = "CASE WHEN relevant THEN 'true' ELSE 'false' END"
    nb = "CASE WHEN relevant THEN 'false' ELSE 'true' END"
    py = "CASE WHEN relevant THEN 'True' ELSE 'False' END"
    up = "CASE WHEN relevant THEN 'TRUE' ELSE 'FALSE' END"
    reason = ("""'"reason": {"query_topic": "' || gold_query_topic || '", "document_topic": "' || gold_document_topic """
              """|| '", "summary": "' || gold_summary || '"}'""")

    def obj(flag):
        return f"""'{{"relevant": ' || {flag} || ', ' || {reason} || '}}'"""

    def fields(query="gold_query_topic", document="gold_document_topic", summary="""'"' || gold_summary || '"'"""):
        topic = f"""'"' || {query} || '"'""" if query else "'null'"
        return (f"""'{{"relevant": ' || {g} || ', "reason": {{"query_topic": ' || {topic} || ', "document_topic": "' || {document} """
                f"""|| '", "summary": ' || {summary} || '}}}}'""")

    exact = obj(g)
    shapes = [
        exact,
        f"'```json' || {NL} || {exact} || {NL} || '```'",
        f"'Answer: ' || {exact}",
        f"{exact} || ' done'",
        f"""'{{"relevant": ' || {g} || ', "reason": {{"query_to'""",
        obj(nb),
        obj("""'"false"'"""),
        obj("'1'"),
        obj("'0'"),
        obj("'null'"),
        f"'{{' || {reason} || '}}'",
        f"""'{{"relevant": ' || {g} || '}}'""",
        f"""'{{"relevant": ' || {g} || ', "reason": {{"query_topic": "' || gold_query_topic || '"}}}}'""",
        f"""'{{"relevant": ' || {g} || ', "reason": "matches"}}'""",
        f"""'{{"relevant": ' || {g} || ', "reason": null}}'""",
        obj(py),
        obj(up),
        g,
        f"""'[{{"relevant": ' || {g} || '}}]'""",
        f"""'{{"relevant": ' || {g} || '}}' || {NL} || '{{"relevant": ' || {nb} || '}}'""",
        "''",
        f"""'{{''relevant'': ' || {g} || '}}'""",
        fields(query="gold_query_topic || ' x'"),
        fields(document="gold_document_topic || ' x'"),
        fields(summary="'\"' || substr(gold_summary, 1, length(gold_summary) // 2) || '\"'"),
        fields(summary="'7'"),
        fields(query=None),
        fields(summary="""'"' || gold_summary || '", "extra": [1, 2]'"""),
    ]
    assert len(shapes) == N_CLASSES
    cases = " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(shapes))
    cls = pick("sample_id", "answer", N_CLASSES)
    heard = f" WHERE {pick('sample_id', 'silent', SILENT_ONE_IN)} <> 0" if silent else ""
    return f"""SELECT sample_id, answer_class, CASE answer_class {cases} END AS answer
  FROM (SELECT *, {cls}::INTEGER AS answer_class FROM gold{heard})"""


ANSWERS = _answer_sql()
ANSWERS_ALL = _answer_sql(silent=False)

NUMERIC_TYPES = "('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'INTEGER', 'UINTEGER')"


def truthy(x: str) -> str:
    """Python truthiness of a DuckDB JSON value (NULL = missing -> false)."""
    return f"""CASE WHEN {x} IS NULL THEN false
      WHEN json_type({x}) = 'NULL' THEN false
      WHEN json_type({x}) = 'BOOLEAN' THEN {x}::VARCHAR = 'true'
      WHEN json_type({x}) = 'VARCHAR' THEN length(json_extract_string({x}, '$')) > 0
      WHEN json_type({x}) = 'ARRAY' THEN json_array_length({x}) > 0
      WHEN json_type({x}) = 'OBJECT' THEN len(json_keys({x})) > 0
      WHEN json_type({x}) IN {NUMERIC_TYPES} THEN {x}::VARCHAR::DOUBLE <> 0
      ELSE false END"""



LENIENT = f"""SELECT sample_id, answer_class,
    CASE WHEN js IS NOT NULL THEN {truthy("json_extract(js, '$.relevant')")}
         WHEN regexp_extract(t2, {lit(RELEVANT_RE)}, 1) <> '' THEN lower(regexp_extract(t2, {lit(RELEVANT_RE)}, 1)) = 'true'
    END AS flag
  FROM (SELECT *, CASE WHEN json_valid(slice) THEN slice END AS js FROM (
    SELECT *, CASE WHEN st > 0 AND fe > 0 AND length(t2) - fe + 1 > st - 1 THEN substr(t2, st, length(t2) - fe + 1 - st + 1) END AS slice
    FROM (SELECT *, strpos(t2, '{{') AS st, strpos(reverse(t2), '}}') AS fe FROM (
      SELECT *, CASE WHEN suffix(t1, '```') THEN substr(t1, 1, length(t1) - 3) ELSE t1 END AS t2 FROM (
        SELECT *, CASE WHEN starts_with(t0, '```json') THEN substr(t0, 8) ELSE t0 END AS t1 FROM (
          SELECT sample_id, answer_class, {py_strip('answer')} AS t0 FROM answers))))))"""

STRICT = f"""SELECT sample_id, answer_class, relevant, gold_query_topic, gold_document_topic, gold_summary,
    js IS NOT NULL AS json_valid,
    coalesce(CASE WHEN json_type(json_extract(jo, '$.relevant')) = 'BOOLEAN'
                  THEN json_extract(jo, '$.relevant')::VARCHAR = CASE WHEN relevant THEN 'true' ELSE 'false' END
                  WHEN json_type(json_extract(jo, '$.relevant')) IN {NUMERIC_TYPES}
                  THEN json_extract(jo, '$.relevant')::VARCHAR::DOUBLE = CASE WHEN relevant THEN 1.0 ELSE 0.0 END
                  ELSE false END, false) AS relevance_match,
    coalesce(json_type(json_extract(jo, '$.reason')) = 'OBJECT'
             AND list_has_all(json_keys(json_extract(jo, '$.reason')), ['query_topic', 'document_topic', 'summary']), false) AS reason_complete,
    CASE WHEN json_type(json_extract(jo, '$.reason.query_topic')) = 'VARCHAR' THEN json_extract_string(jo, '$.reason.query_topic') END AS gq,
    CASE WHEN json_type(json_extract(jo, '$.reason.document_topic')) = 'VARCHAR' THEN json_extract_string(jo, '$.reason.document_topic') END AS gd
  FROM (SELECT *, CASE WHEN json_type(js) = 'OBJECT' THEN js END AS jo FROM (
    SELECT g.*, a.answer_class, CASE WHEN json_valid(t) THEN t END AS js FROM gold g
    LEFT JOIN (SELECT sample_id, answer_class, {py_strip('answer')} AS t FROM answers) a USING (sample_id)))"""

JUDGE = f"""SELECT sample_id, answer_class,
    coalesce(CASE WHEN json_type(js) = 'OBJECT' THEN {truthy("json_extract(js, '$.relevant')")} END, false) AS flag
  FROM (SELECT sample_id, answer_class, CASE WHEN json_valid(answer) THEN answer END AS js FROM answers)"""


def with_ctes(ctes: list[tuple[str, str]], select: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS (\n{q}\n)" for n, q in ctes) + "\n" + select


def eval_ctes(silent: bool = True) -> list[tuple[str, str]]:
    return samples_ctes(2) + [("gold", GOLD), ("answers", ANSWERS if silent else ANSWERS_ALL)]


# ---- retrieval -------------------------------------------------------------------------

MAX_QUERIES = 10
TOP_K = 5

UNIT = """SELECT doc_id, label, len(v) AS dim, nrm,
    CASE WHEN nrm = 0 THEN list_transform(v, lambda x: 0.0) ELSE list_transform(v, lambda x: x / nrm) END AS u
  FROM (SELECT *, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS nrm
        FROM (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v, label FROM embeddings))"""

QUERY_MODULUS = 100  # the query set: every vector whose id is divisible by this
QVECS = f"SELECT * FROM unit WHERE doc_id % {QUERY_MODULUS} = 0"
IVECS = "SELECT * FROM unit WHERE doc_id NOT IN (SELECT doc_id FROM qvecs)"
HITS = f"""SELECT query_id, rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
      SELECT q.doc_id AS query_id, i.doc_id, list_inner_product(q.u, i.u) AS score FROM qvecs q CROSS JOIN ivecs i))
  WHERE rank <= {TOP_K}"""
JUDGED = """SELECT h.query_id, h.doc_id, coalesce(i.label = q.label, false) AS relevant
  FROM hits h LEFT JOIN unit i ON h.doc_id = i.doc_id LEFT JOIN unit q ON h.query_id = q.doc_id"""
PAK = f"SELECT query_id, round(count_if(relevant) / {float(TOP_K)}, 6) AS p_at_k FROM judged GROUP BY query_id"


def retrieval_ctes() -> list[tuple[str, str]]:
    return [("unit", UNIT), ("qvecs", QVECS), ("ivecs", IVECS), ("hits", HITS), ("judged", JUDGED), ("pak", PAK)]


FIRST_QUERIES = f"""SELECT query, first_seen, row_number() OVER (ORDER BY first_seen)::BIGINT AS query_rank FROM (
  SELECT query, min(sample_id) AS first_seen FROM (
    SELECT sample_id, {py_strip("replace(substr(input, 1, cut - 1), 'Query:', '')")} AS query
    FROM (SELECT *, strpos(input, {NL} || 'Document:') AS cut FROM samples) WHERE cut > 0)
  GROUP BY query ORDER BY first_seen LIMIT {MAX_QUERIES})"""


RAG_DIM = 64
_RAG_WORDS = f"""SELECT id, b, count(*)::DOUBLE AS c FROM (
    SELECT id, {pick('w', 'embed', RAG_DIM)} AS b FROM (SELECT id, unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM src))
  GROUP BY id, b"""


def _rag_vectors(src: str) -> str:
    return f"""SELECT id, CASE WHEN nrm = 0 THEN v ELSE list_transform(v, lambda x: x / nrm) END AS u FROM (
    SELECT id, v, sqrt(list_inner_product(v, v)) AS nrm FROM (
      SELECT s.id, list(coalesce(w.c, 0) ORDER BY r.b) AS v
      FROM (SELECT id FROM ({src})) s CROSS JOIN (SELECT unnest(range({RAG_DIM})) AS b) r
      LEFT JOIN ({_RAG_WORDS.replace('FROM src', f'FROM ({src})')}) w ON w.id = s.id AND w.b = r.b GROUP BY s.id))"""


def rag_ctes() -> list[tuple[str, str]]:
    """First queries of the samples, hashed word vectors, hits over the corpus texts."""
    return samples_ctes(2) + [
        ("fq", FIRST_QUERIES),
        ("rq", "SELECT fq.query_rank AS query_id, fq.query, s.query_label AS label FROM fq JOIN samples s ON s.sample_id = fq.first_seen"),
        ("ivec", _rag_vectors("SELECT doc_id AS id, text AS t FROM corpus")),
        ("qvec", _rag_vectors("SELECT query_id AS id, query AS t FROM rq")),
        ("hits", f"""SELECT query_id, rank, doc_id FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
      SELECT q.id AS query_id, i.id AS doc_id, round(list_inner_product(q.u, i.u), 9) AS score FROM qvec q CROSS JOIN ivec i))
  WHERE rank <= {TOP_K}"""),
        ("hit_rows", """SELECT h.*, q.query, q.label AS query_label, c.label, c.text
  FROM hits h JOIN rq q USING (query_id) JOIN corpus c USING (doc_id)""")]


# an answer of the judge per hit, by a draw: none, the label's truth, truthy and false values, no JSON, no object
HIT_SHAPES = 7
HIT_ANSWERS = f"""SELECT query_id, doc_id, CASE shape WHEN 1 THEN CASE WHEN label = query_label THEN '{{"relevant": true}}' ELSE '{{"relevant": false}}' END
    WHEN 2 THEN '{{"relevant": "no"}}' WHEN 3 THEN '{{"relevant": 0}}' WHEN 4 THEN 'relevant: true' WHEN 5 THEN '[true]'
    ELSE '{{"relevant": true, "reason": {{}}}}' END AS answer
  FROM (SELECT *, {pick("concat_ws('|', query_id, doc_id)", 'hit', HIT_SHAPES)} AS shape FROM hit_rows) WHERE shape > 0"""
HIT_JUDGED = f"""SELECT h.query_id, coalesce(CASE WHEN json_type(js) = 'OBJECT' THEN {truthy("json_extract(js, '$.relevant')")} END, false) AS relevant
  FROM hit_rows h LEFT JOIN (SELECT query_id, doc_id, CASE WHEN json_valid(answer) THEN answer END AS js FROM ({HIT_ANSWERS})) a
    ON a.query_id = h.query_id AND a.doc_id = h.doc_id"""


# ---- chat, tokens, masks, batches, loss -------------------------------------------------


BATCH = 4
N_KEEP = 5


def chat_sql(variant: str) -> str:
    system, layout = PROMPT_VARIANTS[variant]
    assert layout == "instruction_input"
    st, en, eos = (lit(CHATML[k]) for k in ("start", "end", "eos"))
    head = (f"{st} || 'system' || {NL} || {lit(system)} || {en} || {NL} || {st} || 'user' || {NL} "
            f"|| instruction || {NL} || input || {en} || {NL}")
    return f"""SELECT sample_id, prompt_text, full_text,
    strpos(substr(full_text, length(prompt_text) + 1), '"relevant"') - 1 AS relevant_idx
  FROM (SELECT sample_id, {head} || {st} || 'assistant' || {NL} AS prompt_text,
               {head} || {st} || 'assistant' || {NL} || output || {eos} || {en} || {NL} AS full_text FROM samples)"""


PIECES = f"""SELECT sample_id, relevant_idx, length(prompt_text) AS prompt_chars,
    regexp_extract_all(prompt_text, {lit(PIECE_RE)}) AS pp, regexp_extract_all(full_text, {lit(PIECE_RE)}) AS fp FROM chat"""
VOCAB = """SELECT piece, cnt AS count, row_number() OVER (ORDER BY cnt DESC, piece) - 1 AS id FROM (
  SELECT piece, count(*) AS cnt FROM (SELECT unnest(fp) AS piece FROM pieces) GROUP BY piece)"""
TOK = f"""SELECT sample_id, relevant_idx, prompt_chars, least(len(pp), {MAX_TOKENS})::BIGINT AS n_prompt,
    len(fp)::BIGINT AS n_full_untruncated, fp[1:{MAX_TOKENS}] AS fpt FROM pieces"""
IDS = """SELECT t.sample_id, list(v.id ORDER BY t.pos) AS input_ids FROM (
    SELECT sample_id, unnest(fpt) AS piece, unnest(range(len(fpt))) AS pos FROM tok) t
  JOIN vocab v USING (piece) GROUP BY t.sample_id"""
TOKS = """SELECT tok.sample_id, tok.relevant_idx, tok.prompt_chars, tok.n_prompt, tok.n_full_untruncated,
    len(tok.fpt)::BIGINT AS n_full, coalesce(ids.input_ids, []) AS input_ids,
    list_transform(tok.fpt, lambda x, i: coalesce(list_sum(list_transform(tok.fpt[1:i - 1], lambda y: length(y))), 0)) AS offsets
  FROM tok LEFT JOIN ids USING (sample_id)"""
EOS_ID = f"SELECT id AS eos_id FROM vocab WHERE piece = {lit(CHATML['eos'])}"


def s1_label(x="x", i="i"):
    return f"CASE WHEN relevant_idx >= 0 AND {i} - 1 >= n_prompt AND {i} - 1 < n_prompt + {N_KEEP} THEN {x} ELSE -100 END"


def s2_label(x="x", i="i"):
    return f"CASE WHEN relevant_idx >= 0 AND {i} - 1 >= n_prompt + {N_KEEP} THEN {x} ELSE -100 END"


def answer_label(x="x", i="i"):
    return f"CASE WHEN {i} - 1 >= n_prompt THEN {x} ELSE -100 END"


def weight(anchor: str, i="i"):
    r = "relevant_idx" if anchor == "reference" else "(relevant_idx + prompt_chars)"
    return (f"CASE WHEN relevant_idx >= 0 AND offsets[{i}] >= {r} AND offsets[{i}] <= {r} + 30 THEN 5.0::DOUBLE "
            f"WHEN {i} - 1 >= n_prompt THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")


MASKS = f"""SELECT *,
    list_transform(input_ids, lambda x, i: {s1_label()}) AS labels_s1,
    list_transform(input_ids, lambda x, i: {s2_label()}) AS labels_s2,
    list_transform(input_ids, lambda x, i: {answer_label()}) AS labels_answer,
    list_transform(input_ids, lambda x, i: {weight('reference')}) AS weights_reference,
    list_transform(input_ids, lambda x, i: {weight('answer')}) AS weights_answer
  FROM toks"""


def token_ctes(version: int, variant: str) -> list[tuple[str, str]]:
    return samples_ctes(version) + [("chat", chat_sql(variant)), ("pieces", PIECES), ("vocab", VOCAB),
                                    ("tok", TOK), ("ids", IDS), ("toks", TOKS), ("masks", MASKS),
                                    ("eos", EOS_ID)]


def txt(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda v: CAST(v AS VARCHAR)), ',')"


BATCHED = f"""SELECT *, pos // {BATCH} AS batch_id, max(n_full) OVER (PARTITION BY pos // {BATCH}) AS max_len FROM (
  SELECT *, row_number() OVER (ORDER BY sample_id) - 1 AS pos FROM masks)"""


def nll(i: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', '{SEED}', sample_id, {i}, 'nll')), 1, 8))::BIGINT % 10000)::DOUBLE / 1000.0::DOUBLE)"


ROW_LOSS = f"""SELECT batch_id,
    coalesce(list_sum(list_transform(range(1, len(input_ids)), lambda t:
      CASE WHEN labels_answer[t + 1] = -100 THEN 0.0 ELSE {nll('t')} END * weights_reference[t + 1])), 0.0) AS num,
    coalesce(list_sum(list_transform(range(1, len(input_ids)), lambda t: weights_reference[t + 1])), 0.0) AS den
  FROM batched"""


# ---- sinks, splits, counts -------------------------------------------------------------------

def jsonl_line(fields=("instruction", "input", "output")) -> str:
    parts = []
    for i, f in enumerate(fields):
        parts.append(lit(("" if i == 0 else ", ") + f'"{f}": '))
        parts.append(f"CAST(to_json({f}) AS VARCHAR)")
    return "'{' || " + " || ".join(parts) + " || '}'"


POSITIONS = "SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM corpus"


def prompt_sql(system: str, user: str) -> str:
    st, en = lit(CHATML["start"]), lit(CHATML["end"])
    return (f"{st} || 'system' || {NL} || {lit(system)} || {en} || {NL} || {st} || 'user' || {NL} || {user} "
            f"|| {en} || {NL} || {st} || 'assistant' || {NL}")
