"""The same results as plain SQL, written for DuckDB over the test tables.

Sums are cast to BIGINT or DOUBLE and rounded as in the queries. The regular
expressions use RE2's ASCII classes; the test texts hold no other digits.
"""

from __future__ import annotations

from deskspark.functions import teacher as T
from deskspark.plans import queries as Q
from deskspark.plans import tables as P

ORACLES: dict[str, str] = {}

_OPEN, _CLOSE = "chr(57344)", "chr(57345)"
_SALT = P.SALT.decode()


def _sql(name: str, body: str, *ctes: str) -> None:
    ORACLES[name] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


# --- redaction ---------------------------------------------------------------

_WHOLE = f"{_OPEN} || '\\0' || {_CLOSE}"
_FINDERS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", _WHOLE),
    ("phone", r"\+[0-9]{1,3}(?:[\s\-.]?[0-9]{1,4}){2,5}", _WHOLE),
    ("phone", r"\([0-9]{3}\)\s*[0-9]{3}[\s\-.]?[0-9]{4}", _WHOLE),
    ("phone", r"\b[0-9]{3}[\s\-.][0-9]{3}[\s\-.][0-9]{4}\b", _WHOLE),
    ("card", r"\b(?:[0-9][ -]?){12,18}[0-9]\b", _WHOLE),
    (
        "account",
        r"((?i:account\s+(?:no\.?|number|#)?|a/c|acct\.?)\s*[#:.]?\s*)([0-9]{8,12})\b",
        f"'\\1' || {_OPEN} || '\\2' || {_CLOSE}",
    ),
]
_DIGITS = "regexp_replace(raw, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda d, i:
    CASE WHEN i % 2 = 1 THEN d::INT WHEN d::INT > 4 THEN 2 * d::INT - 9 ELSE 2 * d::INT END)) % 10 = 0"""
_KEEP = {
    "email": "TRUE",
    "account": "TRUE",
    "phone": f"length({_DIGITS}) BETWEEN 7 AND 15",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}",
}


def _finder(source: str, key: str, i: int) -> str:
    kind, pattern, marking = _FINDERS[i]
    return f"""SELECT {key}, s, e, raw, '{kind}' AS kind, {i} AS finder FROM (
      SELECT {key}, (e - length(raw))::INT AS s, e::INT AS e, raw FROM (
        SELECT {key}, split_part(piece, {_OPEN}, 2) AS raw,
          sum(length(piece) - 1) OVER (PARTITION BY {key} ORDER BY i) AS e, i, n
        FROM (
          SELECT {key}, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i, len(pieces) AS n
          FROM (SELECT {key}, string_split(regexp_replace(text, '{pattern}', {marking}, 'g'), {_CLOSE}) AS pieces
                FROM {source})))
      WHERE i < n)
    WHERE {_KEEP[kind]}"""


def _candidates(source: str, key: str, *kinds: str) -> str:
    wanted = [i for i, f in enumerate(_FINDERS) if not kinds or f[0] in kinds]
    return "candidates AS (" + "\nUNION ALL\n".join(_finder(source, key, i) for i in wanted) + ")"


def _spans(key: str) -> str:
    """Longest first, then earlier start, then finder; greedy without overlaps."""
    return f"""spans AS (
  SELECT {key}, a.s AS s, a.e AS e, a.kind AS kind, a.raw AS raw FROM (
    SELECT {key}, unnest(list_reduce(
      list({{'s': s, 'e': e, 'kind': kind, 'raw': raw}} ORDER BY s - e, s, finder),
      lambda taken, c: CASE WHEN len(list_filter(taken, lambda t: t.s < c.e[1] AND c.s[1] < t.e)) > 0
        THEN taken ELSE list_concat(taken, c) END)) AS a
    FROM candidates GROUP BY {key}))"""


def _spans_recursive(key: str) -> str:
    """Longest first, then earlier start, then finder; greedy without overlaps."""
    return f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY s - e, s, finder) AS r FROM candidates),
taken AS (
  SELECT {key}, 0::BIGINT AS r, CAST([] AS STRUCT(s INT, e INT, kind VARCHAR, raw VARCHAR)[]) AS got
  FROM (SELECT DISTINCT {key} FROM candidates)
  UNION ALL
  SELECT t.{key}, t.r + 1, CASE
    WHEN len(list_filter(t.got, lambda x: x.s < c.e AND c.s < x.e)) > 0 THEN t.got
    ELSE list_append(t.got, {{'s': c.s, 'e': c.e, 'kind': c.kind, 'raw': c.raw}}) END
  FROM taken t JOIN ranked c ON c.{key} = t.{key} AND c.r = t.r + 1),
spans AS (
  SELECT {key}, a.s AS s, a.e AS e, a.kind AS kind, a.raw AS raw FROM (
    SELECT {key}, unnest(got) AS a FROM taken
    WHERE ({key}, r) IN (SELECT {key}, max(r) FROM taken GROUP BY {key})))"""


def _rewritten(source: str, key: str) -> str:
    token = "CASE kind WHEN 'email' THEN '[EMAIL]' WHEN 'phone' THEN '[PHONE]' WHEN 'card' THEN '[CARD]' ELSE '[ACCT]' END"
    return f"""rewritten AS (
  SELECT d.{key}, coalesce(p.head || substr(d.text, p.last_end + 1), d.text) AS redacted_text
  FROM {source} d LEFT JOIN (
    SELECT {key}, string_agg(piece, '' ORDER BY s) AS head, max(e) AS last_end FROM (
      SELECT sp.{key}, s, e, substr(d.text, coalesce(lag(e) OVER w, 0) + 1, s - coalesce(lag(e) OVER w, 0)) || {token} AS piece
      FROM spans sp JOIN {source} d USING ({key}) WINDOW w AS (PARTITION BY sp.{key} ORDER BY s))
    GROUP BY {key}) p USING ({key}))"""


_HASH = f"sha256('{_SALT}' || raw)"
_FOUND = f"SELECT doc_id, s AS span_start, e AS span_end, {_HASH} AS original_hash FROM candidates"
for _kind in ("email", "phone", "card"):
    _sql(f"redact_{_kind}", _FOUND, _candidates("documents", "doc_id", _kind))
_sql(
    "redact_account",
    f"SELECT o_orderkey, s AS span_start, e AS span_end, {_HASH} AS original_hash FROM candidates",
    """told AS (SELECT o_orderkey, 'Account no. ' || lpad(o_orderkey::VARCHAR, 9, '7') || ' paid '
      || o_custkey || ' via a/c ' || lpad(o_custkey::VARCHAR, 7, '5') AS text FROM orders)""",
    _candidates("told", "o_orderkey", "account"),
)
_REDACTION = (_candidates("documents", "doc_id"), _spans_recursive("doc_id"))


def _recursive(name: str, body: str, *ctes: str) -> None:
    _sql(name, body, *ctes)
    ORACLES[name] = ORACLES[name].replace("WITH ", "WITH RECURSIVE ", 1)


_recursive(
    "redact_spans",
    f"SELECT doc_id, s AS span_start, e AS span_end, kind, {_HASH} AS original_hash FROM spans",
    *_REDACTION,
)
_recursive("redact_text", "SELECT * FROM rewritten", *_REDACTION, _rewritten("documents", "doc_id"))
_recursive(
    "pii_profile",
    """SELECT k.kind, count(s.s)::BIGINT AS n_spans, count(DISTINCT s.doc_id)::BIGINT AS n_texts
FROM (VALUES ('email'), ('phone'), ('card'), ('account')) k(kind) LEFT JOIN spans s USING (kind) GROUP BY k.kind""",
    *_REDACTION,
)

# --- derived tables ----------------------------------------------------------

_SPLIT = "CASE WHEN substr(md5('split:' || {0}), 1, 1) < '3' THEN 'val' WHEN substr(md5('split:' || {0}), 1, 1) < '6' THEN 'golden' ELSE 'train' END"
_ITEMS = f"""items AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS e, label, {_SPLIT.format('vec_id')} AS split FROM embeddings)"""
_CENTROIDS = """cells AS (SELECT label AS c, dim, round(avg(x), 6) AS m FROM (
  SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS dim FROM items WHERE split = 'train') GROUP BY label, dim),
centroids AS (SELECT c, list(m ORDER BY dim) AS m FROM cells GROUP BY c)"""
_CLASSES = "classes AS (SELECT DISTINCT label AS label_id, 'class_' || label AS label_name FROM embeddings)"
_SCORES = f"""scores AS (
  SELECT '{P.STUDENT}' AS model, row_id, split, label, c, round({P.STUDENT_SHARPNESS} * list_dot_product(e, m), 6) AS z,
    round(abs(e[2]) * 100.0 + 10.0, 3) AS latency_ms FROM items, centroids
  UNION ALL
  SELECT '{P.BASELINE}', row_id, split, label, c,
    round(-{P.BASELINE_SHARPNESS} * list_sum(list_transform(list_zip(e, m), lambda q: (q[1] - q[2]) * (q[1] - q[2]))), 6),
    round(abs(e[3]) * 50.0 + 5.0, 3) FROM items, centroids)"""


def _probs(t: float = 1.0) -> str:
    return f"""probs AS (
  SELECT model, row_id, split, label, c, z, latency_ms, round(ex / sum(ex) OVER (PARTITION BY model, row_id), 9) AS p FROM (
    SELECT *, exp(z / {t} - max(z / {t}) OVER (PARTITION BY model, row_id)) AS ex FROM scores))"""


_FLAT = """ranks AS (SELECT *, row_number() OVER (PARTITION BY model, row_id ORDER BY p DESC, c) AS place FROM probs),
flat AS (SELECT model, row_id, split, label, c AS pred, p AS conf, latency_ms FROM ranks WHERE place = 1)"""
SCORED = (_ITEMS, _CENTROIDS, _CLASSES, _SCORES)
PREDICTED = (*SCORED, _probs(), _FLAT)

_TEACHER = f"""distances AS (
  SELECT i.row_id, c, round(list_sum(list_transform(list_zip(e, m), lambda q: abs(q[1] - q[2]))), 6) AS d FROM items i, centroids),
nearest AS (SELECT row_id, list(c ORDER BY d, c) AS cs, list(d ORDER BY d, c) AS ds FROM distances GROUP BY row_id),
answers AS (
  SELECT i.row_id, 'message ' || i.row_id AS text, label AS gold_label_id, split,
    CASE WHEN round(ds[2] - ds[1], 6) < {P.UNTYPED_GAP} THEN '{{"intent": 42}}'
      WHEN round(ds[2] - ds[1], 6) < {P.MALFORMED_GAP} THEN 'I am not sure'
      WHEN round(ds[2] - ds[1], 6) < {P.UNSURE_GAP} THEN '{{"intent": "other"}}'
      ELSE '{{"intent": "class_' || cs[1] || '", "note": "x"}}' END AS response,
    700 + floor(abs(e[1]) * 1000)::BIGINT AS input_tokens, 8 + floor(abs(e[4]) * 20)::BIGINT AS output_tokens,
    round(abs(e[5]) * 2000.0 + 800.0, 3) AS latency_ms
  FROM items i JOIN nearest USING (row_id)),
parsed AS (
  SELECT *, CASE WHEN json_valid(response) THEN
    CASE WHEN json_type(response, '$.intent') = 'VARCHAR' THEN json_extract_string(response, '$.intent') END END AS intent
  FROM answers),
labeled AS (
  SELECT p.* EXCLUDE (intent, response), coalesce(intent, '') AS teacher_intent_name,
    coalesce(k.label_id, -1) AS teacher_intent_id,
    CASE WHEN intent IS NULL THEN 'parse_error' WHEN k.label_id IS NULL THEN 'unknown_intent' END AS error,
    g.label_name AS gold_label_name, coalesce(k.label_id, -1) = gold_label_id AS correct
  FROM parsed p LEFT JOIN classes k ON k.label_name = intent LEFT JOIN classes g ON g.label_id = gold_label_id)"""
LABELED = (_ITEMS, _CENTROIDS, _CLASSES, _TEACHER)

_IN, _OUT = 0.30, 2.50


def _tokens_cost(i: str, o: str) -> str:
    return f"(({i} * {_IN} + {o} * {_OUT}) / 1000000)"


# --- messages, prompts, answers ----------------------------------------------

_sql(
    "validate_messages",
    """SELECT (coalesce(length(text), 0) BETWEEN 1 AND 2000)::INT AS accepted, count(*) AS n_rows, max(length(text))::INT AS longest
FROM documents GROUP BY 1""",
)
_sql(
    "rejected_messages",
    """SELECT doc_id::VARCHAR AS request_id, CASE WHEN text IS NULL THEN 'no text' WHEN text = '' THEN 'empty' ELSE 'too long' END AS reason,
  length(text)::INT AS n_chars FROM documents WHERE coalesce(length(text), 0) NOT BETWEEN 1 AND 2000""",
)
_BLOCK = """described AS (SELECT label AS label_id, 'class_' || label AS label_name, 'seen ' || count(*) || ' times' AS description
  FROM embeddings GROUP BY label),
block AS (SELECT string_agg('- ' || label_name || ': ' || description, chr(10) ORDER BY label_id) AS taxonomy_block FROM described)"""
_sql("taxonomy_block", "SELECT * FROM block", _BLOCK)
_sql(
    "taxonomy_fingerprint",
    """SELECT substr(sha256(string_agg(label_name || chr(9) || description, chr(10) ORDER BY label_name)), 1, 16) AS taxonomy_fingerprint,
  count(*) AS n_classes FROM described""",
    _BLOCK,
)
_sql(
    "taxonomy_missing",
    """SELECT DISTINCT lang || '_' || source AS label_name FROM documents
WHERE lang || '_' || source NOT IN (SELECT lang || '_' || source FROM documents JOIN labels USING (doc_id) WHERE quality = 0)""",
)
_sql(
    "build_prompt",
    """SELECT conv_id * 1000 + turn AS row_id,
  'You are an expert intent classifier for a retail bank''s customer support chat queue. Read the customer message below and select the single best intent label from the closed set of classes.'
  || chr(10) || chr(10) || '# Intent classes' || chr(10) || taxonomy_block || chr(10) || chr(10) || '# Customer message' || chr(10) || text
  || chr(10) || chr(10) || 'Respond with JSON containing the chosen intent name (must match one of the class names above exactly).' AS prompt
FROM conversations, block""",
    _BLOCK,
)
_sql("parse_response", "SELECT row_id, teacher_intent_name, teacher_intent_id, error FROM labeled", *LABELED)
_sql(
    "enriched_labels",
    f"""SELECT row_id, teacher_intent_id, gold_label_id, gold_label_name, correct::INT AS correct, split,
  '{P.PROMPT_VERSION}' AS prompt_version, '{P.FINGERPRINT}' AS prompt_fingerprint FROM labeled""",
    *LABELED,
)
_sql(
    "drop_unknown",
    """SELECT split, count(*) FILTER (teacher_intent_id <> -1) AS kept, count(*) FILTER (teacher_intent_id = -1) AS dropped
FROM labeled GROUP BY split""",
    *LABELED,
)
_sql("row_cost", f"SELECT row_id, round({_tokens_cost('input_tokens', 'output_tokens')}, 9) AS cost_usd FROM labeled", *LABELED)
_sql(
    "estimate_cost",
    f"""SELECT n_rows, avg_in AS avg_input_tokens, 15 AS avg_output_tokens, round({_tokens_cost('avg_in', '15')} * n_rows, 6) AS estimated_usd
FROM (SELECT (SELECT count(*) FROM conversations) AS n_rows, length(taxonomy_block) // 4 + 80 AS avg_in FROM block)""",
    _BLOCK,
)

# --- label tables ------------------------------------------------------------

_GUARD = """SELECT count(*) AS n_rows, min(split) AS first_split, max(split) AS last_split, 0::BIGINT AS null_splits,
  '{0}' AS expected_split, {1} AS ok FROM labeled {2}"""
_sql(
    "split_guard",
    "\nUNION ALL\n".join(
        [_GUARD.format(s, 1, f"WHERE split = '{s}'") for s in ("val", "golden", "train")]
        + [_GUARD.format("train", 0, "")]
    ),
    *LABELED,
)
_sql(
    "lineage_check",
    f"""SELECT split, count(*) AS n_rows, min(fp) AS fingerprint, (min(fp) = max(fp))::INT AS one_fingerprint, min(v) AS version,
  (min(v) = max(v))::INT AS one_version, count(*) FILTER (fp IS NULL) AS null_fingerprints FROM (
  SELECT split, CASE WHEN split = 'val' AND row_id % 7 = 0 THEN '00c0ffee00c0ffef'
      WHEN split <> 'golden' OR row_id % 11 <> 0 THEN '{P.FINGERPRINT}' END AS fp,
    CASE WHEN split = 'train' AND row_id % 13 = 0 THEN '2' ELSE '{P.PROMPT_VERSION}' END AS v FROM items) GROUP BY split""",
    _ITEMS,
)
_sql(
    "training_tables",
    f"""SELECT split, count(*) FILTER (teacher_intent_id <> -1) AS kept, sum(row_id) FILTER (teacher_intent_id <> -1)::BIGINT AS id_total,
  count(*) FILTER (teacher_intent_id = -1) AS dropped, '{P.PROMPT_VERSION}' AS prompt_version, '{P.FINGERPRINT}' AS prompt_fingerprint
FROM labeled WHERE split <> 'golden' GROUP BY split""",
    *LABELED,
)
_sql(
    "split_head",
    "SELECT row_id, 'message ' || row_id AS text, split FROM items WHERE split = 'val' ORDER BY row_id LIMIT 25",
    _ITEMS,
)
_RUNS = "runs AS (SELECT unnest(['2026-05-01T08-00-00Z', '2026-05-02T08-00-00Z']) AS run_id)"
_sql(
    "labels_sink",
    """SELECT split, run_id, count(*) AS n_rows, sum(input_tokens)::BIGINT AS input_total, count(error) AS errors
FROM labeled, runs GROUP BY split, run_id""",
    *LABELED,
    _RUNS,
)
_sql(
    "latest_run",
    "SELECT max(run_id) AS run_id, split, count(DISTINCT row_id) AS n_rows FROM items, runs GROUP BY split",
    _ITEMS,
    _RUNS,
)
_sql(
    "run_id_from_path",
    "SELECT 'run-' || split AS run_id, split, count(*) AS n_rows FROM items GROUP BY split",
    _ITEMS,
)
_sql(
    "golden_snapshot",
    "SELECT label, 2 * count(*) AS n_reads, count(*) AS n_rows FROM items WHERE split = 'golden' GROUP BY label",
    _ITEMS,
)
_MESSAGES = "messages AS (SELECT conv_id * 1000 + turn AS row_id, text FROM conversations)"
_sql(
    "resume_pending",
    "SELECT row_id, length(text)::INT AS n_chars FROM messages WHERE length(text) >= 300",
    _MESSAGES,
)
_sql("resume_union", "SELECT row_id, length(text)::INT AS n_chars FROM messages", _MESSAGES)
_sql(
    "label_job",
    f"""SELECT row_id, response, input_tokens, output_tokens FROM summed
WHERE {_tokens_cost('(i - input_tokens)', '(o - output_tokens)')} <= {Q.JOB_CAP_USD}""",
    _MESSAGES,
    f"""paid AS (SELECT row_id,
    '{{"intent": "' || CASE WHEN length(text) > 400 THEN 'long' ELSE 'short' END || '"}}' AS response,
    length(text) // 4 + 80 AS input_tokens, 15::BIGINT AS output_tokens FROM messages)""",
    """summed AS (SELECT *, sum(input_tokens) OVER w AS i, sum(output_tokens) OVER w AS o FROM paid WINDOW w AS (ORDER BY row_id))""",
)
_FRAME = len(T.PROMPT_HEADER) + len(T.CLASSES_HEADING) + len(T.MESSAGE_HEADING) + len(T.PROMPT_FOOTER) + 9
_FRAME += sum(len(f"- {name}: {told}") for name, told in P.LENGTH_CLASSES.items())
_sql(
    "label_job_full",
    f"""SELECT row_id, CASE WHEN length(text) > 400 THEN 'long' ELSE 'short' END AS teacher_intent_name,
  (length(text) > 400)::INT AS teacher_intent_id, (length(text) + {_FRAME}) // 4 AS input_tokens, 'train' AS split,
  '2026-05-01T08-00-00Z' AS run_id, (length(text) <= 400)::INT AS correct FROM messages""",
    _MESSAGES,
)
_sql(
    "budget_cutoff",
    f"""SELECT row_id, round({_tokens_cost('i', 'o')}, 9) AS spent_usd FROM (
  SELECT row_id, input_tokens, output_tokens, sum(input_tokens) OVER w AS i, sum(output_tokens) OVER w AS o
  FROM labeled WINDOW w AS (ORDER BY row_id))
WHERE {_tokens_cost('(i - input_tokens)', '(o - output_tokens)')} <= {Q.BUDGET_USD}""",
    *LABELED,
)
_sql(
    "labeling_summary",
    f"""SELECT split, count(*) AS n_rows, count(error) AS errors, round(count(error) / count(*), 6) AS error_rate,
  round(avg(correct::INT), 6) AS teacher_vs_gold_accuracy, sum(input_tokens)::BIGINT AS input_total,
  sum(output_tokens)::BIGINT AS output_total, round({_tokens_cost('sum(input_tokens)', 'sum(output_tokens)')}, 6) AS cost_usd,
  round(quantile_cont(latency_ms, 0.50), 6) AS latency_ms_p50, round(quantile_cont(latency_ms, 0.95), 6) AS latency_ms_p95,
  round(quantile_cont(latency_ms, 0.99), 6) AS latency_ms_p99
FROM labeled GROUP BY split""",
    *LABELED,
)
_sql(
    "label_distribution",
    "SELECT teacher_intent_name, count(*) AS n FROM labeled WHERE teacher_intent_id <> -1 GROUP BY 1",
    *LABELED,
)
_sql(
    "ceiling_accuracy",
    """SELECT split, count(*) AS subset_size, count(*) FILTER (teacher_intent_id <> -1) AS n_valid,
  round(coalesce(avg(correct::INT) FILTER (teacher_intent_id <> -1), 0.0), 6) AS ceiling_top1_accuracy, count(error) AS error_count
FROM labeled GROUP BY split""",
    *LABELED,
)
_BY_CLASS = """by_class AS (SELECT gold_label_name, count(*) AS n, count(*) FILTER (correct) AS correct,
  round(avg(correct::INT), 6) AS accuracy FROM labeled GROUP BY 1)"""
_sql("class_accuracy", "SELECT * FROM by_class", *LABELED, _BY_CLASS)
_sql(
    "worst_classes",
    "SELECT * FROM by_class ORDER BY correct / n, n DESC, gold_label_name LIMIT 5",
    *LABELED,
    _BY_CLASS,
)
_sql(
    "error_overview",
    """SELECT split, count(*) AS total, count(*) FILTER (correct) AS correct, round(avg(correct::INT), 6) AS accuracy,
  count(*) FILTER (NOT correct) AS misses, round(avg((NOT correct)::INT), 6) AS miss_rate,
  count(*) FILTER (NOT correct AND teacher_intent_id = -1) AS parse_errors
FROM labeled GROUP BY split""",
    *LABELED,
)
_PAIRS = """mistakes AS (SELECT * FROM labeled WHERE NOT correct AND teacher_intent_id <> -1),
pairs AS (SELECT gold_label_name, teacher_intent_name, count(*) AS n, min(row_id) AS first_row_id FROM mistakes
  GROUP BY 1, 2 ORDER BY n DESC, first_row_id LIMIT 20)"""
_sql("error_pairs", "SELECT * FROM pairs", *LABELED, _PAIRS)
_sql(
    "confusion_examples",
    """SELECT * FROM (
  SELECT gold_label_name, teacher_intent_name,
    (row_number() OVER (PARTITION BY gold_label_name, teacher_intent_name ORDER BY row_id))::INT AS example, row_id, text
  FROM mistakes JOIN pairs USING (gold_label_name, teacher_intent_name)) WHERE example <= 3""",
    *LABELED,
    _PAIRS,
)

# --- scores ------------------------------------------------------------------

_sql("softmax_temperature", "SELECT model, row_id, c AS label_id, p FROM probs", *SCORED, _probs(2.5))
_sql(
    "class_projection",
    """SELECT model, row_id, c AS label_id, round(coalesce(ex / sum(ex) OVER (PARTITION BY model, row_id), 0.0), 9) AS p FROM (
  SELECT s.model, s.row_id, s.c,
    CASE WHEN k.c IS NOT NULL THEN exp(z - max(CASE WHEN k.c IS NOT NULL THEN z END) OVER (PARTITION BY model, row_id)) END AS ex
  FROM scores s LEFT JOIN seen k USING (c))""",
    *SCORED,
    """seen AS (SELECT label AS c FROM embeddings GROUP BY label
  HAVING count(*) >= (SELECT count(*) / count(DISTINCT label) FROM embeddings))""",
)
_sql(
    "teacher_one_hot",
    """SELECT row_id, c.label_id, round(CASE WHEN teacher_intent_id < 0 THEN 1.0 / (SELECT count(*) FROM classes)
  WHEN teacher_intent_id = c.label_id THEN 1.0 ELSE 0.0 END, 9)::DOUBLE AS p FROM labeled, classes c""",
    *LABELED,
)
_sql(
    "top_k_intents",
    "SELECT model, row_id, (place - 1)::INT AS place, 'class_' || c AS intent, p FROM ranks WHERE place <= 3",
    *PREDICTED,
)
_sql("argmax_confidence", "SELECT model, row_id, pred, conf FROM flat", *PREDICTED)

# --- metrics -----------------------------------------------------------------

_sql(
    "top_k_accuracy",
    "\nUNION ALL\n".join(
        f"SELECT model, {k} AS k, round(avg((place <= {k})::INT), 6) AS accuracy, count(*) AS n FROM ranks WHERE c = label GROUP BY model"
        for k in (1, 3, 5)
    ),
    *PREDICTED,
)
_PER_CLASS = """models AS (SELECT DISTINCT model FROM flat),
per_class AS (
  SELECT model, label_id, support, coalesce(tp / nullif(predicted, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall,
    coalesce(2 * tp / nullif(support + predicted, 0), 0.0) AS f1 FROM (
    SELECT m.model, k.label_id, (SELECT count(*) FROM flat f WHERE f.model = m.model AND f.label = k.label_id) AS support,
      (SELECT count(*) FROM flat f WHERE f.model = m.model AND f.pred = k.label_id) AS predicted,
      (SELECT count(*) FROM flat f WHERE f.model = m.model AND f.pred = k.label_id AND f.label = k.label_id) AS tp
    FROM models m, classes k))"""
_sql("macro_f1", "SELECT model, round(avg(f1), 6) AS macro_f1 FROM per_class GROUP BY model", *PREDICTED, _PER_CLASS)
_sql(
    "per_class_metrics",
    """SELECT model, label_id, 'class_' || label_id AS class_name, support, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, round(recall, 6) AS top1_accuracy FROM per_class""",
    *PREDICTED,
    _PER_CLASS,
)
_sql(
    "worst_classes_f1",
    """SELECT model, label_id, 'class_' || label_id AS class_name, f1 FROM (
  SELECT model, label_id, round(f1, 6) AS f1, row_number() OVER (PARTITION BY model ORDER BY round(f1, 6), label_id) AS place FROM per_class)
WHERE place <= 4""",
    *PREDICTED,
    _PER_CLASS,
)
_MATRIX = """models AS (SELECT DISTINCT model FROM flat),
cells2 AS (SELECT model, label, pred, count(*) AS n FROM flat GROUP BY ALL),
matrix AS (
  SELECT m.model, a.label_id AS label, b.label_id AS pred, coalesce(n, 0) AS n,
    coalesce(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY m.model, a.label_id), 0), 0.0) AS value
  FROM models m CROSS JOIN classes a CROSS JOIN classes b
  LEFT JOIN cells2 x ON x.model = m.model AND x.label = a.label_id AND x.pred = b.label_id)"""
_sql("confusion_matrix", "SELECT model, label, pred, n, round(value, 6) AS value FROM matrix", *PREDICTED, _MATRIX)
_sql(
    "top_confusion_pairs",
    """SELECT model, label, pred, value, 'class_' || label AS true_name, 'class_' || pred AS pred_name FROM (
  SELECT model, label, pred, round(value, 9) AS value,
    row_number() OVER (PARTITION BY model ORDER BY round(value, 9) DESC, label, pred) AS place FROM matrix WHERE label <> pred)
WHERE place <= 20""",
    *PREDICTED,
    _MATRIX,
)
_EDGES = ", ".join(repr(i * (1 / 15)) for i in range(1, 15))
_BINS = f"""binned AS (SELECT *, len(list_filter([{_EDGES}]::DOUBLE[], lambda x: x <= conf))::INT AS bin FROM flat),
grouped AS (SELECT model, bin, count(*) AS n, avg(conf) AS mc, avg((label = pred)::INT) AS acc FROM binned GROUP BY model, bin)"""
_sql(
    "ece",
    "SELECT model, round(sum(n * abs(mc - acc)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM grouped GROUP BY model",
    *PREDICTED,
    _BINS,
)
_sql(
    "reliability_bins",
    """SELECT m.model, b.bin::INT AS bin, coalesce(n, 0) AS n, round(coalesce(mc, 0.0), 6) AS mean_confidence, round(coalesce(acc, 0.0), 6) AS accuracy
FROM (SELECT DISTINCT model FROM flat) m CROSS JOIN range(15) b(bin) LEFT JOIN grouped g ON g.model = m.model AND g.bin = b.bin""",
    *PREDICTED,
    _BINS,
)
_sql(
    "nll_at_t",
    "\nUNION ALL\n".join(
        f"""SELECT model, {t}::DOUBLE AS temperature, round(avg(top + ln(s) - mine), 6) AS nll FROM (
  SELECT model, row_id, any_value(top) AS top, sum(exp(z / {t} - top)) AS s, max(CASE WHEN c = label THEN z / {t} END) AS mine FROM (
    SELECT *, max(z / {t}) OVER (PARTITION BY model, row_id) AS top FROM scores) GROUP BY model, row_id) GROUP BY model"""
        for t in (0.5, 1.0, 2.0)
    ),
    *SCORED,
)
_sql(
    "agreement",
    """SELECT model, round(avg((pred = teacher_intent_id)::INT), 6) AS vs_teacher, round(avg((pred = label)::INT), 6) AS vs_truth, count(*) AS n
FROM flat JOIN labeled USING (row_id) WHERE teacher_intent_id <> -1 GROUP BY model""",
    *PREDICTED,
    _TEACHER,
)

ORACLES["agreement_bucketed"] = ORACLES["agreement"]

# --- thresholds --------------------------------------------------------------

_WALK = """walk AS (SELECT *, avg((label = pred)::INT) OVER (PARTITION BY model, {0} pred ORDER BY conf DESC, row_id
  ROWS UNBOUNDED PRECEDING) AS rp FROM flat {1})"""
_sql(
    "running_precision",
    "SELECT model, pred, row_id, round(rp, 6) AS running_precision FROM walk",
    *PREDICTED,
    _WALK.format("", ""),
)
_FIT = (
    _WALK.format("", "WHERE split = 'val'"),
    f"""limits AS (SELECT m.model, k.label_id, coalesce(min(conf), 1.01) AS threshold
  FROM (SELECT DISTINCT model FROM flat) m CROSS JOIN classes k
  LEFT JOIN walk w ON w.model = m.model AND w.pred = k.label_id AND rp >= {Q.TARGET} GROUP BY ALL)""",
    "routed AS (SELECT f.*, threshold, conf >= threshold AS accepted FROM flat f JOIN limits l ON l.model = f.model AND l.label_id = f.pred)",
)
_sql("fit_thresholds", "SELECT * FROM limits", *PREDICTED, *_FIT)
_sql(
    "apply_thresholds",
    "SELECT model, row_id, pred, threshold, accepted::INT AS accepted FROM routed",
    *PREDICTED,
    *_FIT,
)
_sql(
    "threshold_summary",
    """SELECT model, label_id, 'class_' || label_id AS class_name, threshold AS fitted_threshold,
  round(coalesce(n_right / nullif(n_accepted, 0), 0.0), 6) AS val_precision, round(coalesce(n_right / nullif(n_true, 0), 0.0), 6) AS val_recall, n_accepted
FROM (SELECT l.*,
    (SELECT count(*) FROM routed r WHERE split = 'val' AND r.model = l.model AND r.pred = l.label_id AND accepted) AS n_accepted,
    (SELECT count(*) FROM routed r WHERE split = 'val' AND r.model = l.model AND r.pred = l.label_id AND accepted AND label = pred) AS n_right,
    (SELECT count(*) FROM routed r WHERE split = 'val' AND r.model = l.model AND r.label = l.label_id) AS n_true FROM limits l)""",
    *PREDICTED,
    *_FIT,
)
_sql("threshold_store", "SELECT model, label_id, threshold FROM limits WHERE model IN ('baseline', 'student')", *PREDICTED, *_FIT)
_sql(
    "routing_stats",
    """SELECT model, count(*) AS n_rows, count(*) FILTER (accepted) AS n_accepted, round(avg(accepted::INT), 6) AS acceptance_rate,
  round(coalesce(avg((label = pred)::INT) FILTER (accepted), 0.0), 6) AS precision_among_accepted,
  (SELECT count(*) FROM limits l WHERE l.model = r.model AND threshold = 1.01) AS n_classes_escalate_all
FROM routed r WHERE split = 'golden' GROUP BY model""",
    *PREDICTED,
    *_FIT,
)

# --- cost and latency --------------------------------------------------------

_sql(
    "latency_percentiles",
    """SELECT event_type AS model, round(quantile_cont(value, 0.50), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
  round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""",
)
_sql(
    "latency_source",
    """SELECT event_type AS model, CASE event_type WHEN 'purchase' THEN 'cloud_run_load_test' ELSE 'laptop_dev' END AS latency_source,
  count(*) AS n, round(avg(value), 6) AS mean_ms FROM events GROUP BY 1, 2""",
)
_SERVE = "(sum({0}) / 1000.0 * (1.0 * 0.000024 + 2.0 * 0.0000025) + count(*) * 0.40 / 1e6) / count(*) * 1000.0"
_TEACH = f"{_tokens_cost('sum(input_tokens)', 'sum(output_tokens)')} / count(*) * 1000.0"
_sql(
    "cost_teacher_per_1k",
    f"SELECT split, count(*) AS n, round({_TEACH}, 6) AS cost_per_1k_usd FROM labeled GROUP BY split",
    *LABELED,
)
_sql(
    "cost_student_per_1k",
    f"SELECT event_type AS model, count(*) AS n, round({_SERVE.format('value')}, 9) AS cost_per_1k_usd FROM events GROUP BY 1",
)
_sql(
    "price_sheet_cost",
    f"""SELECT event_type AS model, count(*) AS n, round(2 * ({_SERVE.format('value')}), 8) AS cost_per_1k_usd, '2026-06' AS pricing_date
FROM events GROUP BY 1""",
)
_sql(
    "cost_breakdown",
    """SELECT '2026-05' AS pricing_date, round(t, 6) AS teacher_cost_per_1k_usd, round(s, 6) AS student_cost_per_1k_usd,
  round(t / s, 1) AS student_cost_reduction_vs_teacher_x, round(b, 6) AS baseline_cost_per_1k_usd,
  round(t / b, 1) AS baseline_cost_reduction_vs_teacher_x, NULL::VARCHAR AS note FROM costs""",
    *SCORED,
    _TEACHER,
    f"""costs AS (SELECT (SELECT {_TEACH} FROM labeled) AS t,
  (SELECT {_SERVE.format('latency_ms')} FROM scores WHERE model = 'student' AND c = 0) AS s,
  (SELECT {_SERVE.format('latency_ms')} FROM scores WHERE model = 'baseline' AND c = 0) AS b)""",
)
_ALL_FLAT = """teacher_flat AS (SELECT 'teacher' AS model, row_id, split, gold_label_id AS label, greatest(teacher_intent_id, 0) AS pred,
  CASE WHEN teacher_intent_id < 0 THEN round(1.0 / (SELECT count(*) FROM classes), 9)::DOUBLE ELSE 1.0::DOUBLE END AS conf, latency_ms FROM labeled),
everyone AS (SELECT * FROM (SELECT model, row_id, split, label, pred, conf, latency_ms FROM flat UNION ALL
  SELECT model, row_id, split, label, pred, conf, latency_ms FROM teacher_flat) WHERE split = 'golden')"""
_sql(
    "headline_metrics",
    f"""SELECT e.model, round(avg((label = pred)::INT), 6) AS top_1_accuracy, any_value(round(f.macro_f1, 6)) AS macro_f1,
  any_value(round(b.ece, 6)) AS ece, round(quantile_cont(latency_ms, 0.95), 6) AS latency_ms_p95,
  round(CASE e.model WHEN 'teacher' THEN (SELECT {_TEACH} FROM labeled WHERE split = 'golden') ELSE {_SERVE.format('latency_ms')} END, 6) AS cost_per_1k_usd
FROM everyone e JOIN f1s f ON f.model = e.model JOIN errors b ON b.model = e.model GROUP BY e.model""",
    *PREDICTED,
    _TEACHER,
    _ALL_FLAT,
    _PER_CLASS.replace("flat", "everyone"),
    "f1s AS (SELECT model, avg(f1) AS macro_f1 FROM per_class GROUP BY model)",
    _BINS.replace("FROM flat", "FROM everyone"),
    "errors AS (SELECT model, sum(n * abs(mc - acc)) / sum(n) AS ece FROM grouped GROUP BY model)",
)

_sql(
    "results_document",
    f"""SELECT m.*, r.n_accepted, round(r.n_accepted / m.n, 6) AS acceptance_rate,
  round(coalesce(r.n_right / nullif(r.n_accepted, 0), 0.0), 6) AS precision_among_accepted,
  (SELECT count(*) FROM limits l WHERE l.model = m.model AND threshold = 1.01) AS n_classes_escalate_all,
  {Q.TARGET}::DOUBLE AS target_precision FROM (
  SELECT e.model, round(avg((label = pred)::INT), 6) AS top_1_accuracy, any_value(round(h.top_5, 6)) AS top_5_accuracy,
    any_value(round(f.macro_f1, 6)) AS macro_f1, any_value(round(b.ece, 6)) AS ece, count(*) AS n,
    (SELECT count(*) FROM classes) AS n_classes,
    CASE e.model WHEN 'baseline' THEN 'cloud_run_load_test' ELSE 'laptop_dev' END AS latency_source,
    round(quantile_cont(latency_ms * CASE e.model WHEN 'baseline' THEN 2 ELSE 1 END, 0.50), 6) AS latency_ms_p50,
    round(quantile_cont(latency_ms * CASE e.model WHEN 'baseline' THEN 2 ELSE 1 END, 0.95), 6) AS latency_ms_p95,
    round(quantile_cont(latency_ms * CASE e.model WHEN 'baseline' THEN 2 ELSE 1 END, 0.99), 6) AS latency_ms_p99,
    round(CASE e.model WHEN 'teacher' THEN (SELECT {_TEACH} FROM labeled WHERE split = 'golden') ELSE {_SERVE.format('latency_ms')} END, 6) AS cost_per_1k_usd
  FROM everyone e JOIN f1s f ON f.model = e.model JOIN errors b ON b.model = e.model LEFT JOIN fives h ON h.model = e.model
  GROUP BY e.model) m
LEFT JOIN (SELECT model, count(*) FILTER (accepted) AS n_accepted, count(*) FILTER (accepted AND label = pred) AS n_right
  FROM routed WHERE split = 'golden' GROUP BY model) r ON r.model = m.model
WHERE m.model <> 'teacher' UNION ALL BY NAME SELECT * FROM taught""",
    *PREDICTED,
    *_FIT,
    _TEACHER,
    _ALL_FLAT,
    _PER_CLASS.replace("flat", "everyone"),
    "f1s AS (SELECT model, avg(f1) AS macro_f1 FROM per_class GROUP BY model)",
    _BINS.replace("FROM flat", "FROM everyone"),
    "errors AS (SELECT model, sum(n * abs(mc - acc)) / sum(n) AS ece FROM grouped GROUP BY model)",
    "fives AS (SELECT model, avg((place <= 5)::INT) AS top_5 FROM ranks WHERE c = label AND split = 'golden' GROUP BY model)",
    f"""taught AS (SELECT 'teacher' AS model, round(avg((label = pred)::INT), 6) AS top_1_accuracy, NULL::DOUBLE AS top_5_accuracy,
    any_value(round(f.macro_f1, 6)) AS macro_f1, any_value(round(b.ece, 6)) AS ece, count(*) AS n,
    (SELECT count(*) FROM classes) AS n_classes, 'laptop_dev' AS latency_source,
    round(quantile_cont(latency_ms, 0.50), 6) AS latency_ms_p50, round(quantile_cont(latency_ms, 0.95), 6) AS latency_ms_p95,
    round(quantile_cont(latency_ms, 0.99), 6) AS latency_ms_p99, (SELECT round({_TEACH}, 6) FROM labeled WHERE split = 'golden') AS cost_per_1k_usd,
    NULL::BIGINT AS n_accepted, NULL::DOUBLE AS acceptance_rate, NULL::DOUBLE AS precision_among_accepted,
    NULL::BIGINT AS n_classes_escalate_all, NULL::DOUBLE AS target_precision
  FROM everyone e JOIN f1s f ON f.model = e.model JOIN errors b ON b.model = e.model WHERE e.model = 'teacher' GROUP BY e.model)""",
)

# The slope of the loss in the inverse temperature rises, so halving its bracket finds the zero.
_BISECTION = """lists AS (
  SELECT g, row_id, list(z - top ORDER BY c) AS zs, max(CASE WHEN c = label THEN z - top END) AS own FROM (
    SELECT *, max(z) OVER (PARTITION BY g, row_id) AS top FROM told) GROUP BY g, row_id),
halved AS (
  SELECT g, 0 AS i, 0.01::DOUBLE AS lo, 20.0::DOUBLE AS hi FROM (SELECT DISTINCT g FROM told)
  UNION ALL
  SELECT g, i + 1, CASE WHEN slope > 0 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN slope > 0 THEN (lo + hi) / 2 ELSE hi END FROM (
    SELECT h.g, h.i, h.lo, h.hi, avg(list_dot_product(zs, es) / list_sum(es) - own) AS slope FROM (
      SELECT h.*, l.zs, l.own, list_transform(l.zs, lambda z: exp(z * (h.lo + h.hi) / 2)) AS es
      FROM halved h JOIN lists l ON l.g = h.g WHERE h.i < 60) h GROUP BY ALL)),
temperatures AS (SELECT g, 2 / (lo + hi) AS temperature FROM halved WHERE i = 60)"""
_recursive(
    "fit_temperature",
    "SELECT split_part(g, ':', 1) AS model, split_part(g, ':', 2) AS split, round(temperature, 6) AS temperature FROM temperatures",
    *SCORED,
    "told AS (SELECT model || ':' || split AS g, row_id, label, c, z FROM scores)",
    _BISECTION,
)
_recursive(
    "calibration_report",
    f"""SELECT p.g AS model, any_value(round(t.temperature, 6)) AS temperature, round(sum(n * abs(mc - acc)) FILTER (stage = 'pre') / sum(n) FILTER (stage = 'pre'), 6) AS ece_pre,
  round(sum(n * abs(mc - acc)) FILTER (stage = 'post') / sum(n) FILTER (stage = 'post'), 6) AS ece_post,
  round(sum(n * acc) FILTER (stage = 'pre') / sum(n) FILTER (stage = 'pre'), 6) AS val_accuracy_vs_truth,
  round(sum(n * alike) FILTER (stage = 'pre') / sum(n) FILTER (stage = 'pre'), 6) AS val_accuracy_vs_teacher,
  (sum(n) FILTER (stage = 'pre'))::BIGINT AS n_val, 15 AS n_bins
FROM (SELECT g, stage, bin, count(*) AS n, avg(conf) AS mc, avg((pred = label)::INT) AS acc, avg((pred = taught)::INT) AS alike FROM (
  SELECT *, len(list_filter([{_EDGES}]::DOUBLE[], lambda x: x <= conf))::INT AS bin FROM staged) GROUP BY g, stage, bin) p
JOIN temperatures t USING (g) GROUP BY p.g""",
    *SCORED,
    _TEACHER,
    """told AS (SELECT s.model AS g, s.row_id, s.label, c, z, l.teacher_intent_id AS taught FROM scores s JOIN labeled l USING (row_id)
  WHERE s.split = 'val' AND l.teacher_intent_id <> -1)""",
    _BISECTION,
    """softened AS (SELECT g, row_id, label, taught, stage, c, exp(z / t - max(z / t) OVER w) AS ex FROM (
    SELECT told.*, 'pre' AS stage, 1.0 AS t FROM told UNION ALL SELECT told.*, 'post', temperature FROM told JOIN temperatures USING (g))
  WINDOW w AS (PARTITION BY g, stage, row_id)),
staged AS (SELECT g, row_id, label, taught, stage, arg_max(c, (ex, -c)) AS pred, max(ex) / sum(ex) AS conf FROM softened GROUP BY ALL)""",
)

# --- sampling and data checks ------------------------------------------------


def _sample(source: str, n: str, seed: int) -> str:
    """Largest-remainder quotas, then the lowest tickets of each class."""
    return f"""sizes AS (SELECT label, count(*) AS size, {n} AS wanted, sum(count(*)) OVER () AS total FROM {source} GROUP BY label),
quotas AS (
  SELECT label, (wanted * size / total)::DOUBLE AS exact, floor(wanted * size / total)::BIGINT AS base,
    row_number() OVER (ORDER BY (wanted * size / total) - floor(wanted * size / total) DESC, label) AS remainder_rank,
    wanted - sum(floor(wanted * size / total)) OVER () AS leftover FROM sizes),
drawn AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.label ORDER BY md5('{seed}:' || s.row_id), s.row_id)
    <= base + (remainder_rank <= leftover)::INT AS sampled FROM {source} s JOIN quotas q ON q.label = s.label)"""


_EVENT_ROWS = "rows AS (SELECT event_id AS row_id, event_type AS label FROM events)"
_DRAW_EVENTS = _sample("rows", "(SELECT ceil(0.1 * count(*)) FROM rows)", 42)
_sql(
    "stratified_split",
    "SELECT row_id, label, CASE WHEN sampled THEN 'val' ELSE 'train' END AS split FROM drawn",
    _EVENT_ROWS,
    _DRAW_EVENTS,
)
_sql(
    "stratified_subsample",
    "SELECT row_id, label FROM drawn WHERE sampled",
    "rows AS (SELECT doc_id AS row_id, lang AS label FROM documents)",
    _sample("rows", "150", 7),
)
_sql(
    "split_class_drift",
    """SELECT round(max(abs(a - b)), 9) AS max_share_difference FROM (
  SELECT label, count(*) FILTER (sampled) / (SELECT count(*) FROM drawn WHERE sampled) AS a,
    count(*) FILTER (NOT sampled) / (SELECT count(*) FROM drawn WHERE NOT sampled) AS b FROM drawn GROUP BY label)""",
    _EVENT_ROWS,
    _DRAW_EVENTS,
)
_DOC_SPLIT = f"docs AS (SELECT doc_id, text, {_SPLIT.format('doc_id')} AS split FROM documents)"
_sql(
    "split_leakage",
    """SELECT p.a AS split_a, p.b AS split_b, count(y.text) AS shared_texts
FROM (VALUES ('golden', 'train'), ('golden', 'val'), ('train', 'val')) p(a, b)
JOIN (SELECT DISTINCT split, text FROM docs) x ON x.split = p.a
LEFT JOIN (SELECT DISTINCT split, text FROM docs) y ON y.split = p.b AND y.text = x.text GROUP BY 1, 2""",
    _DOC_SPLIT,
)
_sql(
    "dataset_quality",
    """SELECT source AS split, count(*) AS n_rows, count(*) - count(text) AS null_texts, count(*) - count(lang) AS null_labels,
  count(DISTINCT lang) AS n_classes, min(lang) AS min_label, max(lang) AS max_label FROM documents GROUP BY source""",
)
_sql(
    "embed_cache_misses",
    f"""SELECT DISTINCT sha256('{Q.ENCODER}' || chr(0) || text) AS cache_key, length(text)::INT AS n_chars FROM docs
WHERE text NOT IN (SELECT text FROM docs WHERE split = 'train')""",
    _DOC_SPLIT,
)

_sql(
    "embed_cache_fill",
    """SELECT doc_id, CAST(length(text) AS DOUBLE) AS e0, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS e1,
    CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS e2, CAST(length(text) - length(replace(text, 'a', '')) AS DOUBLE) AS e3,
    (SELECT count(DISTINCT text) FROM docs WHERE split = 'train') AS added_1,
    (SELECT count(DISTINCT text) FROM docs) - (SELECT count(DISTINCT text) FROM docs WHERE split = 'train') AS added_2,
    CAST(0 AS BIGINT) AS added_3
FROM docs""",
    _DOC_SPLIT,
)

# At the optimum every component of the gradient is zero.
_sql(
    "lr_certificate",
    """SELECT label, component::INT AS component, 0.0::DOUBLE AS gradient_share
FROM (SELECT DISTINCT label FROM items WHERE split = 'train'), (SELECT unnest(range(-1, (SELECT max(len(e)) FROM items))) AS component)""",
    _ITEMS,
)

# --- scoring -----------------------------------------------------------------

_LOGITS = ", ".join(
    f"len(regexp_extract_all(lower(redacted_text), '{P.word_pattern(w)}')) / 2.0".replace("\n", "\\n")
    for w in P.LANGUAGE_WORDS.values()
)
_SCORING = (
    "requests AS (SELECT conv_id || '-' || turn AS request_id, text FROM conversations WHERE length(text) BETWEEN 1 AND 2000)",
    _candidates("requests", "request_id"),
    _spans_recursive("request_id"),
    _rewritten("requests", "request_id"),
    f"logits AS (SELECT request_id, redacted_text, [{_LOGITS}] AS z FROM rewritten)",
    f"""ps AS (SELECT request_id, redacted_text, unnest({list(P.LANGUAGE_WORDS)!r}) AS intent, generate_subscripts(z, 1) AS c,
    unnest(list_transform(z, lambda v: exp(v - list_max(z)))) AS ex FROM logits)""",
    """placed AS (SELECT *, ex / sum(ex) OVER (PARTITION BY request_id) AS p,
    row_number() OVER (PARTITION BY request_id ORDER BY ex DESC, c) AS place FROM ps)""",
    """audited AS (SELECT request_id, 'lang-1' AS model_version, any_value(redacted_text) AS input_text_redacted,
    any_value(intent) FILTER (place = 1) AS predicted_intent, round(max(p), 6) AS confidence,
    string_agg(intent, ',' ORDER BY place) FILTER (place <= 3) AS top_k_intents, 3 AS k FROM placed GROUP BY request_id)""",
)
for _name in ("batch_scoring", "stream_scoring"):
    _recursive(_name, "SELECT * FROM audited", *_SCORING)
_recursive(
    "stream_outputs",
    """SELECT request_id, predicted_intent, NULL::VARCHAR AS reason FROM audited
UNION ALL SELECT request_id, NULL, CASE WHEN text IS NULL THEN 'no text' WHEN text = '' THEN 'empty' ELSE 'too long' END
FROM asked WHERE coalesce(length(text), 0) NOT BETWEEN 1 AND 2000""",
    """asked AS (SELECT conv_id || '-' || turn AS request_id,
    CASE WHEN turn % 5 = 0 THEN '' WHEN turn % 7 = 0 THEN repeat(text, 99) ELSE text END AS text FROM conversations)""",
    "requests AS (SELECT * FROM asked WHERE length(text) BETWEEN 1 AND 2000)",
    *_SCORING[1:],
)
_recursive(
    "audit_log", "SELECT *, (SELECT count(*) FROM audited) AS n_dated FROM audited", *_SCORING
)
_sql(
    "own_redactor_and_writer",
    """SELECT conv_id || '-' || turn AS request_id, regexp_replace(text, '[0-9]', '#', 'g') AS input_text_redacted
FROM conversations WHERE length(text) BETWEEN 1 AND 2000""",
)
