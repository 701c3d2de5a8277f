"""DuckDB restatements of the registered queries (the correctness oracle).

Each statement is written from the rule, in SQL idiom (window functions,
lambdas, CASE), not by transcribing the Spark plan.  Tables are the driver's
pre-registered views.  Doubles produced by division are rounded to 6 places on
both sides; counts are cast to BIGINT.
"""

from __future__ import annotations

# Fixed values, written out here so that a wrong constant in the library shows.
ANSWER_IS = r"The answer is\s+(\d+\.?\d*|\d*\.\d+)"
CURRENCY_CHARS = "[$€£¥,]"
KEYWORD_ANSWER = (r"(?i)(?:answer|result|total|sum)(?:\s+is|\s*=|\s*:)\s*(\d+\.?\d*)"
                  r"|(\d+\.?\d*)(?:\s*is the answer)")
NUMBER = r"[-+]?\d*\.?\d+"
UNSIGNED_NUMBER = r"(\d+\.?\d*|\d*\.\d+)"
UNIT_WORDS = ("dollars USD euros EUR pounds GBP yen JPY yuan CNY rupees INR % percent units kg g mg m cm mm km mph lbs oz "
              "inches feet ft tons hours hrs minutes mins seconds secs").split()
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
                 "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
CHAT_ZERO_SHOT_INSTRUCTION = "Let's solve it step by step. You must give your final answer as an integer after '####'"
FEW_SHOT_INSTRUCTION = "Answer: Let's solve this step by step. I'll write the final answer after ####.\n"
STEP_BY_STEP_HEAD = 'Solve this step-by-step:\n'
STEP_BY_STEP_TAIL = '\n\nThink through this carefully:\n1. '
THINK_INSTRUCTION = """Let's think step by step. At the end, you MUST write the answer as an integer after '####'. Ensure your answer is fully written before stopping.
"""
ZERO_SHOT_INSTRUCTION = "Let's solve it step by step. Make sure to stop immediately after writing the final answer. You MUST write the final answer as an integer after '####'."
EIGHT_SHOT_PROMPT = """Q: There are 15 trees in the grove. Grove workers will plant trees in the grove today. After they are done, there will be 21 trees. How many trees did the grove workers plant today?
A: There are 15 trees originally. Then there were 21 trees after some more were planted. So there must have been 21 - 15 = 6. The answer is 6.

Q: If there are 3 cars in the parking lot and 2 more cars arrive, how many cars are in the parking lot?
A: There are originally 3 cars. 2 more cars arrive. 3 + 2 = 5. The answer is 5.

Q: Leah had 32 chocolates and her sister had 42. If they ate 35, how many pieces do they have left in total?
A: Originally, Leah had 32 chocolates. Her sister had 42. So in total they had 32 + 42 = 74. After eating 35, they had 74 - 35 = 39. The answer is 39.

Q: Jason had 20 lollipops. He gave Denny some lollipops. Now Jason has 12 lollipops. How many lollipops did Jason give to Denny?
A: Jason started with 20 lollipops. Then he had 12 after giving some to Denny. So he gave Denny 20 - 12 = 8. The answer is 8.

Q: Shawn has five toys. For Christmas, he got two toys each from his mom and dad. How many toys does he have now?
A: Shawn started with 5 toys. If he got 2 toys each from his mom and dad, then that is 4 more toys. 5 + 4 = 9. The answer is 9.

Q: There were nine computers in the server room. Five more computers were installed each day, from monday to thursday. How many computers are now in the server room?
A: There were originally 9 computers. For each of 4 days, 5 more computers were added. So 5 * 4 = 20 computers were added. 9 + 20 is 29. The answer is 29.

Q: Michael had 58 golf balls. On tuesday, he lost
23 golf balls. On wednesday, he lost 2 more. How many golf balls did he have at the end of wednesday?
A: Michael started with 58 golf balls. After losing 23 on tuesday, he had 58 - 23 = 35. After losing 2 more, he had 35 - 2 = 33 golf balls. The answer is 33.

Q: Olivia has $23. She bought five bagels for $3 each. How much money does she have left?
A: Olivia had 23 dollars. 5 bagels for 3 dollars each will be 5 x 3 = 15 dollars. So she has 23 - 15 dollars left. 23 - 15 is 8. The answer is 8.

Q: {question}
A:"""
TOKEN_PATTERN = '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\n\\r\\f\\x0B]'


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


WS = " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE)
UNITS = r"(\d+)\s*(?:" + "|".join(UNIT_WORDS) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def clean(x: str) -> str:
    return (f"regexp_replace(regexp_replace({x}, {q(CURRENCY_CHARS)}, '', 'g'), "
            f"{q(UNITS)}, '\\1', 'g')")


def nums(x: str, pattern: str = NUMBER, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


def extract_answer(t: str) -> str:
    mark = f"CASE WHEN contains({t}, '####') THEN {nums(clean(f'string_split({t}, {q(chr(35) * 4)})[-1]'))}[1] END"
    walk = (f"CASE WHEN contains({t}, '<|endoftext|>') THEN list_filter(list_transform("
            f"list_reverse(string_split({t}, '<|endoftext|>')), lambda p: {nums(clean('p'))}), "
            f"lambda l: len(l) > 0)[1][1] END")
    last = f"{nums(clean(t))}[-1]"
    return f"TRY_CAST(COALESCE({mark}, {walk}, {last}) AS DOUBLE)"


def extract_answer_plain(t: str) -> str:
    mark = f"CASE WHEN contains({t}, '####') THEN {nums(f'string_split({t}, {q(chr(35) * 4)})[-1]')}[1] END"
    return f"TRY_CAST(COALESCE({mark}, {nums(t)}[-1]) AS DOUBLE)"


def extract_predicted(t: str, fallback: bool = True) -> str:
    said = f"NULLIF(regexp_extract({t}, {q(ANSWER_IS)}, 1), '')"
    if fallback:
        said = f"COALESCE({said}, {nums(t, UNSIGNED_NUMBER, 1)}[-1])"
    return f"TRY_CAST({said} AS DOUBLE)"


def extract_keyword(t: str) -> str:
    return (f"COALESCE(NULLIF(regexp_extract({t}, {q(KEYWORD_ANSWER)}, 1), ''), "
            f"NULLIF(regexp_extract({t}, {q(KEYWORD_ANSWER)}, 2), ''), {t})")


def whole(v: str) -> str:
    return f"COALESCE({v} = floor({v}) AND NOT isinf({v}) AND NOT isnan({v}), false)"


def is_correct(p: str, g: str) -> str:
    return (f"(CASE WHEN {p} IS NULL OR {g} IS NULL THEN false "
            f"WHEN {whole(p)} AND {whole(g)} THEN {p} = {g} "
            f"ELSE abs({p} - {g}) / (abs({g}) + 1e-10) < 0.01 END)")


def closeness(p: str, g: str) -> str:
    return (f"(CASE WHEN {p} IS NULL OR {g} IS NULL THEN 'no_answer' "
            f"WHEN abs({p} - {g}) < 1e-6 THEN 'correct' ELSE 'incorrect' END)")


# ---------------------------------------------------------------- views ----

V_RESPONSES = """
responses AS (
  SELECT l_linestatus AS run, l_orderkey AS question_id,
         l_linenumber, l_partkey, l_suppkey,
         CASE l_partkey % 6
           WHEN 0 THEN 'Adding up gives ' || CAST(floor(l_quantity) AS BIGINT) || ' apples. #### $' || CAST(floor(l_quantity) AS BIGINT)
           WHEN 1 THEN 'Thus it is #### 1,00' || CAST(floor(l_quantity) AS BIGINT)
           WHEN 2 THEN 'We get ' || CAST(floor(l_quantity) AS BIGINT) || ' - ' || (l_suppkey % 10) || '. The answer is ' || CAST(floor(l_quantity) AS BIGINT) || '.'
           WHEN 3 THEN CAST(floor(l_quantity) AS BIGINT) || '<|endoftext|>' || (l_suppkey % 10) || ' dollars'
           WHEN 4 THEN 'total = ' || CAST(floor(l_quantity) AS BIGINT) || ' kg'
           ELSE 'I am not sure.'
         END AS response
  FROM lineitem)"""

V_GOLD = """
gold AS (
  SELECT o_orderkey AS question_id,
         'How much is order ' || o_orderkey || '?' AS question,
         'The items add up. #### ' || (CAST(floor(o_totalprice) AS BIGINT) % 50 + 1) AS answer
  FROM orders)"""


def with_views(*views: str) -> str:
    return "WITH " + ",".join(views)


# ------------------------------------------------------------- queries -----

def _vote_results() -> str:
    return with_views(V_RESPONSES, V_GOLD, f"""
ext AS (
  SELECT run, question_id, {extract_answer('response')} AS numeric,
         row_number() OVER (PARTITION BY run, question_id
                            ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos
  FROM responses),
tally AS (
  SELECT run, question_id, numeric, count(*) AS c, min(pos) AS first_pos
  FROM ext WHERE numeric IS NOT NULL GROUP BY ALL),
winner AS (
  SELECT run, question_id, numeric AS majority_answer, c AS majority_votes FROM (
    SELECT *, row_number() OVER (PARTITION BY run, question_id ORDER BY c DESC, first_pos) AS r
    FROM tally) WHERE r = 1),
per_q AS (
  SELECT run, question_id, count(*) AS n_votes, count(numeric) AS n_answered
  FROM ext GROUP BY ALL),
res AS (
  SELECT p.run, p.question_id, CAST(p.n_votes AS BIGINT) AS n_votes,
         CAST(p.n_answered AS BIGINT) AS n_answered, w.majority_answer,
         {extract_answer('g.answer')} AS gold_answer
  FROM per_q p LEFT JOIN winner w USING (run, question_id)
  LEFT JOIN gold g ON g.question_id = p.question_id)""")


def vote_results_sql() -> str:
    return _vote_results() + f"""
SELECT run, question_id, n_votes, n_answered, majority_answer, gold_answer,
       {is_correct('majority_answer', 'gold_answer')} AS correct,
       COALESCE(majority_answer = gold_answer, false) AS exact,
       {closeness('majority_answer', 'gold_answer')} AS closeness
FROM res"""


def eval_accuracy_sql() -> str:
    return _vote_results() + f"""
SELECT run, (SELECT count(*) FROM gold) AS n_total,
       CAST(sum(CASE WHEN {is_correct('majority_answer', 'gold_answer')} THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
       round(sum(CASE WHEN {is_correct('majority_answer', 'gold_answer')} THEN 1 ELSE 0 END)
             / (SELECT count(*) FROM gold), 6) AS accuracy
FROM res GROUP BY run"""


def first_vote_accuracy_sql() -> str:
    return with_views(V_RESPONSES, V_GOLD, f"""
first_votes AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY run, question_id
                                 ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos
    FROM responses) WHERE pos = 1),
res AS (
  SELECT f.run, f.question_id, {extract_answer('f.response')} AS pred,
         {extract_answer('g.answer')} AS gold_answer
  FROM first_votes f LEFT JOIN gold g USING (question_id))""") + f"""
SELECT run, (SELECT count(*) FROM gold) AS n_total,
       CAST(sum(CASE WHEN {is_correct('pred', 'gold_answer')} THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
       round(sum(CASE WHEN {is_correct('pred', 'gold_answer')} THEN 1 ELSE 0 END)
             / (SELECT count(*) FROM gold), 6) AS accuracy
FROM res GROUP BY run"""


def running_accuracy_sql() -> str:
    return _vote_results() + f"""
SELECT run, question_id, {is_correct('majority_answer', 'gold_answer')} AS correct,
       CAST(row_number() OVER w - 1 AS BIGINT) AS example_idx,
       CAST(sum(CASE WHEN {is_correct('majority_answer', 'gold_answer')} THEN 1 ELSE 0 END) OVER w AS BIGINT) AS running_correct,
       round(sum(CASE WHEN {is_correct('majority_answer', 'gold_answer')} THEN 1 ELSE 0 END) OVER w
             / row_number() OVER w, 6) AS running_accuracy
FROM res
WINDOW w AS (PARTITION BY run ORDER BY question_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def answer_extraction_sql() -> str:
    return with_views(V_RESPONSES) + f"""
SELECT run, question_id, l_linenumber, l_partkey, l_suppkey,
       {extract_answer('response')} AS extracted,
       {extract_answer_plain('response')} AS extracted_plain,
       {extract_predicted('response')} AS predicted,
       {extract_predicted('response', False)} AS ground_truth,
       {extract_keyword('response')} AS keyword_answer,
       {clean('response')} AS cleaned
FROM responses"""


# ---------------------------------------------------------- completions ----

def _piece(x: str, delim_sql: str, i: int) -> str:
    """Python text.split(delim)[i] (0-based, negative from the end)."""
    return f"string_split({x}, {delim_sql})[{i + 1 if i >= 0 else i}]"


NL = "chr(10)"


def completions_sql() -> str:
    decoded = (f"('Q: question ' || question_id || {NL} || 'A: ' || response || {NL} || {NL} || "
               f"'Q: next one #### 7' || {NL} || {NL} || 'A: 8</s>')")
    chat = f"('Question: ' || question_id || {NL} || 'Answer: ' || response || '  ')"
    prompt = f"('Question: ' || question_id || {NL} || 'Answer: ')"
    post = (f"CASE WHEN contains(d, '####') THEN {_piece('d', q('####'), 0)} || '####' || "
            f"{_piece(_piece('d', q('####'), 1), f'{NL} || {NL}', 0)} ELSE d END")
    last_a = strip(_piece('d', q('A:'), -1))
    after = (f"CASE WHEN len(string_split(d, 'A:')) > 1 THEN (CASE WHEN contains({last_a}, 'Q:') "
             f"THEN {strip(_piece(last_a, q('Q:'), 0))} ELSE {last_a} END) ELSE '' END")
    after_uncut = f"CASE WHEN len(string_split(d, 'A:')) > 1 THEN {last_a} ELSE '' END"
    cut = r"regexp_split_to_array(response || ' Q: again', 'Q:|</s>|<\|im_end\|>')[1]"
    completion = (f"CASE WHEN (CASE WHEN l_partkey % 2 = 0 THEN 'qwen' ELSE 'gpt2' END) IN ('llama', 'deepseek', 'qwen') "
                  f"THEN {strip(_piece(chat, q('Answer:'), -1))} "
                  f"ELSE {strip(f'substr({chat}, length({prompt}) + 1)')} END")
    eos_cut = f"CASE WHEN contains(d, '</s>') THEN {strip(_piece('d', q('</s>'), 0))} ELSE d END"
    return with_views(V_RESPONSES, f"""
dec AS (SELECT *, {decoded} AS d FROM responses)""") + f"""
SELECT run, question_id, l_linenumber, l_partkey, l_suppkey,
       {post} AS post_processed, {after} AS after_last_a, {after_uncut} AS after_last_a_uncut,
       {cut} AS cut, {completion} AS completion,
       {extract_answer(f'({eos_cut})')} AS extracted_eos
FROM dec"""


PY_FLOAT_SQL = (r"[-+]?(?:(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)"
                r"(?:[eE][-+]?\d(?:_?\d)*)?|(?i:inf|infinity|nan))")


def number_parsing_sql() -> str:
    s = strip("token")
    value = f"CASE WHEN regexp_full_match({s}, {q(PY_FLOAT_SQL)}) THEN CAST(replace({s}, '_', '') AS DOUBLE) END"
    return with_views(V_RESPONSES, """
toks AS (
  SELECT question_id, l_linenumber, l_partkey, l_suppkey,
         unnest(string_split(response, ' ')) AS token,
         generate_subscripts(string_split(response, ' '), 1) - 1 AS pos
  FROM responses)""", f"""
parsed AS (SELECT *, {value} AS value FROM toks)""") + f"""
SELECT question_id, l_linenumber, l_partkey, l_suppkey, CAST(pos AS INTEGER) AS pos, token, value,
       {whole('value')} AS is_whole
FROM parsed"""


# ----------------------------------------------------------- curriculum ----

V_PROBLEMS = f"""
problems AS (
  SELECT p_partkey AS pid,
         CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS body,
         '  How many ' || p_type || ' parts?' || {NL} AS question,
         CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_size || '*2' END AS equation,
         CAST(p_size * 2 AS VARCHAR) AS answer,
         [CAST(p_size * 2 AS VARCHAR), CAST(p_size * 2 + 1 AS VARCHAR), CAST(p_size * 3 AS VARCHAR), p_brand] AS options,
         CASE WHEN p_partkey % 11 = 0 THEN 'Double it. Answer: ' || (p_size * 2)
              ELSE 'Double ' || p_size || ' to get ' || (p_size * 2) || '.' END AS rationale,
         ['A', 'B', 'C', 'D'][p_partkey % 4 + 1] AS correct
  FROM part)"""


def _t(x):
    return strip(f"coalesce({x}, '')")


V_RENDERED = f"""
rendered AS (
  SELECT 'ASDiv' AS dataset, 1 AS stage, pid AS row_key,
         'Question: ' || CASE WHEN {_t('body')} <> '' THEN {_t('body')} || ' ' ELSE '' END || {_t('question')} || {NL}
         || CASE WHEN {_t('equation')} <> '' THEN 'Solution: ' || {_t('equation')} || {NL} ELSE '' END
         || 'Answer: ' || {_t('answer')} AS text
  FROM problems
  UNION ALL
  SELECT 'ParaMAWPS', 2, pid, 'Question: ' || {_t('question')} || {NL} || 'Equation: ' || {_t('equation')}
         || {NL} || 'Answer: ' || {_t('answer')}
  FROM problems
  UNION ALL
  SELECT 'SVAMP', 3, pid, 'Question: ' || {strip("coalesce(body, '') || ' ' || coalesce(question, '')")}
         || CASE WHEN {_t('equation')} <> '' THEN {NL} || 'Equation: ' || {_t('equation')} ELSE '' END
         || {NL} || 'Answer: ' || {_t('answer')}
  FROM problems
  UNION ALL
  SELECT 'DMath', 4, pid, 'Question: ' || {_t('question')} || {NL} || 'Solution: ' || {_t('equation')}
         || {NL} || 'Answer: ' || {_t('answer')}
  FROM problems
  UNION ALL
  SELECT 'AQuA', 5, pid, 'Question: ' || {_t('question')} || {NL} || 'Options:' || {NL}
         || array_to_string(list_transform(options, lambda o, i: chr(CAST(64 + i AS INTEGER)) || '. ' || o || {NL}), '')
         || 'Rationale: ' || {_t('rationale')} || {NL} || 'Answer: ' || coalesce(correct, '')
  FROM problems)"""

SOLVED = "'Let me solve this step by step.' || chr(10) || {s} || chr(10) || 'Therefore, the answer is ' || {a} || '.'"

V_STANDARD = f"""
split1 AS (
  SELECT *, {_piece('text', q('Question: '), 1)} AS body,
         CASE WHEN dataset IN ('ASDiv', 'DMath') THEN 'Solution' ELSE 'Equation' END AS skey
  FROM rendered),
split2 AS (SELECT *, string_split(body, {NL} || skey || ':') AS qp FROM split1),
split3 AS (SELECT *, string_split(qp[2], {NL} || 'Answer:') AS sa FROM split2),
aqua AS (
  SELECT *, {strip(_piece(_piece('text', q('Question: '), 1), q('Rationale:'), 0))} AS qpart FROM rendered
  WHERE dataset = 'AQuA'),
aqua_std AS (
  SELECT dataset, stage, row_key, text,
         CASE WHEN qpart IS NULL THEN NULL
              WHEN contains(qpart, 'Options:') THEN {strip(_piece('qpart', q('Options:'), 0))} || {NL} || 'Options:' || {NL} || {strip(_piece('qpart', q('Options:'), 1))}
              ELSE qpart END AS question,
         CASE WHEN qpart IS NULL THEN NULL ELSE
           {SOLVED.format(
               s=f"(CASE WHEN contains(text, 'Rationale:') THEN {strip(_piece(_piece('text', q('Rationale:'), 1), q('Answer:'), 0))} ELSE '' END)",
               a=f"(CASE WHEN contains(text, 'Answer:') THEN {strip(_piece('text', q('Answer:'), 1))} ELSE '' END)")}
         END AS answer
  FROM aqua),
standard AS (
  SELECT dataset, stage, row_key, text,
         CASE WHEN qp[1] IS NOT NULL AND sa[1] IS NOT NULL AND sa[2] IS NOT NULL THEN {strip('qp[1]')} END AS question,
         CASE WHEN qp[1] IS NOT NULL AND sa[1] IS NOT NULL AND sa[2] IS NOT NULL
              THEN {SOLVED.format(s=strip('sa[1]'), a=strip('sa[2]'))} END AS answer
  FROM split3 WHERE dataset <> 'AQuA'
  UNION ALL
  SELECT * FROM aqua_std)"""


def curriculum_standardised_sql() -> str:
    return with_views(V_PROBLEMS, V_RENDERED, V_STANDARD) + """
SELECT dataset, stage, row_key, text, question, answer FROM standard"""


def curriculum_counts_sql() -> str:
    return with_views(V_PROBLEMS, V_RENDERED, V_STANDARD) + """
SELECT dataset, CAST(count(*) AS BIGINT) AS n_raw,
       CAST(sum(CASE WHEN question IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_kept
FROM standard GROUP BY ROLLUP (dataset)"""


def curriculum_splits_sql() -> str:
    return with_views(V_PROBLEMS, V_RENDERED, V_STANDARD, """
kept AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY row_key) AS rn
    FROM standard WHERE question IS NOT NULL)
  WHERE dataset <> 'AQuA' OR rn <= 15000),
shuffled AS (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('42:' || row_key), row_key) - 1 AS pos,
         count(*) OVER (PARTITION BY dataset) AS n
  FROM kept)""") + f"""
SELECT dataset, stage, row_key, question, answer,
       '###Question: ' || question || {NL} || '###Answer: ' || answer AS prompt,
       CASE WHEN pos < ceil(0.1 * n) THEN 'test' ELSE 'train' END AS split,
       CAST(pos AS BIGINT) AS shuffle_pos
FROM shuffled"""


# ------------------------------------------------------------- sampling ----

def corpus_shuffle_sql() -> str:
    return """
SELECT doc_id, lang, source,
       CAST(row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS BIGINT) AS shuffle_pos
FROM documents"""


def corpus_sample_sql() -> str:
    return """
SELECT doc_id, lang, source FROM (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS pos,
         floor(count(*) OVER () * 0.05) AS n
  FROM documents) WHERE pos < n"""


def corpus_split_sql() -> str:
    return """
SELECT doc_id, lang, CASE WHEN pos < ceil(0.1 * n) THEN 'test' ELSE 'train' END AS split,
       CAST(pos AS BIGINT) AS shuffle_pos
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) - 1 AS pos,
             count(*) OVER (PARTITION BY lang) AS n FROM documents)"""


def corpus_head_sql() -> str:
    return "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 100"


def corpus_nth_sql() -> str:
    return "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 1 OFFSET 5"


# -------------------------------------------------------------- prompts ----

def few_shot_prompts_sql() -> str:
    head, tail = EIGHT_SHOT_PROMPT.split("{question}")
    p = f"(b.block || 'Question: ' || d.text || {NL} || {q(FEW_SHOT_INSTRUCTION)})"
    excerpt = (f"CASE WHEN length({p}) > 500 THEN left({p}, 250) || '...' || {NL} || '...' || right({p}, 250) "
               f"ELSE {p} END")
    return f"""
WITH shots AS (
  SELECT item_id, text, md5('42:' || item_id) AS h FROM benchmark ORDER BY h, item_id LIMIT 5),
block AS (
  SELECT string_agg('Question: ' || text || {NL} || 'Answer: ' || '#### ' || item_id || {NL} || {NL}, ''
                    ORDER BY h, item_id) AS block FROM shots)
SELECT d.doc_id AS qid, {p} AS prompt,
       md5('Question: ' || b.block || ' ' || {q(THINK_INSTRUCTION)}) AS shots_only_md5,
       md5({NL} || b.block || {NL} || {NL} || 'Question: ' || d.text || {NL} || {q(THINK_INSTRUCTION)}) AS shots_then_question_md5,
       md5({q(head)} || d.text || {q(tail)}) AS eight_shot_md5,
       md5(d.text || {q(ZERO_SHOT_INSTRUCTION)}) AS zero_shot_md5,
       md5(d.text || {q(CHAT_ZERO_SHOT_INSTRUCTION)}) AS chat_zero_shot_md5,
       md5({q(STEP_BY_STEP_HEAD)} || d.text || {q(STEP_BY_STEP_TAIL)}) AS step_by_step_md5,
       {excerpt} AS prompt_excerpt
FROM documents d CROSS JOIN block b"""


V_INSTRUCTIONS = """
ins AS (
  SELECT u.conv_id, u.turn, u.text AS instruction, a.text AS output,
         CASE WHEN u.conv_id % 3 = 0 THEN 'data/PoT/' ELSE 'data/CoT/' END || (u.conv_id % 5) AS source
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""


def instruction_prompts_sql() -> str:
    return with_views(V_INSTRUCTIONS) + f"""
SELECT conv_id, turn, source,
       'Instruction' || {NL} || coalesce(instruction, '') || {NL} || 'Response' || {NL} || coalesce(output, '') AS formatted_text
FROM ins WHERE source IS NOT NULL AND NOT starts_with(source, 'data/PoT/')"""


def source_counts_sql() -> str:
    return with_views(V_INSTRUCTIONS) + """
SELECT source, CAST(count(*) AS BIGINT) AS n FROM ins GROUP BY source"""


def source_counts_peek_sql() -> str:
    return with_views(V_INSTRUCTIONS) + """
SELECT source, CAST(count(*) AS BIGINT) AS n
FROM (SELECT * FROM ins ORDER BY conv_id, turn LIMIT 1000) GROUP BY source"""


def chat_prompts_sql() -> str:
    turn = f"'<|im_start|>' || role || {NL} || text || '<|im_end|>' || {NL}"
    return f"""
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       coalesce(string_agg({turn}, '' ORDER BY turn, {turn}), '') || '<|im_start|>assistant' || {NL} AS prompt
FROM conversations GROUP BY conv_id"""


# ---------------------------------------------------------- leaderboard ----

NUMERIC_TEXT_SQL = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def _num(x):
    return f"CASE WHEN regexp_full_match({x}, {q(NUMERIC_TEXT_SQL)}) THEN TRY_CAST(trim({x}) AS DOUBLE) END"


def _v_leaderboard(metric: str = "score_txt") -> str:
    return f"""
lb AS (
  SELECT p_partkey AS row_key, p_name AS "Name", p_brand AS "Family",
         strftime(date '2022-01-01' + to_months(CAST(p_partkey % 40 AS INTEGER)), '%y-%b') AS published,
         CASE WHEN p_partkey % 5 = 0 THEN 'unknown' WHEN p_partkey % 13 = 0 THEN ''
              ELSE CAST(floor(p_size / 4) AS BIGINT) || '.' || ((p_size % 4) * 25) END AS size_txt,
         CASE WHEN p_partkey % 11 = 0 THEN ''
              ELSE ((p_partkey * 37) % 100) || CASE WHEN p_partkey % 3 = 0 THEN '.5' ELSE '' END END AS score_txt
  FROM part),
typed AS (
  SELECT row_key, "Name", "Family", CAST(strptime(published || '-01', '%y-%b-%d') AS DATE) AS "Date",
         {_num('size_txt')} AS size, {_num(metric)} AS score
  FROM lb),
typed2 AS (
  SELECT *, size IS NOT NULL AS has_size,
         CASE WHEN size IS NOT NULL THEN log10(size) * 200 ELSE 100.0 END AS size_normalised,
         CASE WHEN size IS NOT NULL THEN "Name" || ' (' || CAST(trunc(size) AS BIGINT) || 'B)' ELSE "Name" END AS label
  FROM typed),
fam AS (
  SELECT "Family", first_date, first_key,
         CAST(row_number() OVER (ORDER BY first_date, first_key) - 1 AS BIGINT) AS family_idx
  FROM (SELECT "Family", "Date" AS first_date, row_key AS first_key,
               row_number() OVER (PARTITION BY "Family" ORDER BY "Date", row_key) AS r FROM typed2)
  WHERE r = 1),
palette AS (
  SELECT *, ['#1f77b4', '#ff7f0e', '#2ca02c', '#d62728', '#9467bd', '#8c564b', '#e377c2',
             '#7f7f7f', '#bcbd22', '#17becf'][family_idx % 10 + 1] AS colour FROM fam)"""


def leaderboard_zoom_sql() -> str:
    return with_views(_v_leaderboard()) + """
SELECT t.row_key, t."Name", t."Family", t."Date", t.size, t.has_size,
       round(t.size_normalised, 6) AS size_normalised, t.score, t.label,
       COALESCE(t."Date" BETWEEN DATE '2024-01-01' AND DATE '2025-03-01' AND t.score BETWEEN 40 AND 80, false) AS in_box,
       p.family_idx, p.colour
FROM typed2 t LEFT JOIN palette p USING ("Family")
WHERE t."Date" >= DATE '2024-01-01' AND t.score >= 40"""


def leaderboard_axis_sql() -> str:
    return with_views(_v_leaderboard()) + """
SELECT CAST(min("Date") - INTERVAL 15 DAY AS DATE) AS min_date,
       CAST(max("Date") + INTERVAL 15 DAY AS DATE) AS max_date,
       CAST(38.0 AS DOUBLE) AS min_score, max(score) + 2.0 AS max_score, CAST(count(*) AS BIGINT) AS n_points
FROM typed2 WHERE "Date" >= DATE '2024-01-01' AND score >= 40"""


def leaderboard_families_sql() -> str:
    return with_views(_v_leaderboard()) + """
SELECT "Family", first_date, first_key, family_idx, colour FROM palette"""


def leaderboard_size_split_sql() -> str:
    return with_views(_v_leaderboard("score_txt")) + """
SELECT "Family", CAST(sum(CASE WHEN has_size THEN 1 ELSE 0 END) AS BIGINT) AS n_with_size,
       CAST(sum(CASE WHEN has_size THEN 0 ELSE 1 END) AS BIGINT) AS n_without_size
FROM typed2 GROUP BY "Family" """


def leaderboard_thresholds_sql() -> str:
    def n(c):
        return f"CAST(sum(CASE WHEN COALESCE({c}, false) THEN 1 ELSE 0 END) AS BIGINT)"
    s24 = "\"Date\" >= DATE '2024-01-01'"
    return with_views(_v_leaderboard()) + f"""
SELECT {n(f'{s24} AND score >= 40')} AS n_40, {n(f'{s24} AND score >= 70')} AS n_70,
       {n(f'{s24} AND score >= 75')} AS n_75, {n(f'{s24} AND score >= 79')} AS n_79,
       {n("\"Date\" >= DATE '2022-01-01'")} AS n_since_2022, {n(f'{s24} AND score >= 101')} AS n_101,
       {n(f'{s24} AND score >= 101')} = 0 AS empty_101
FROM typed2"""


# --------------------------------------------------------------- runlog ----

V_STEPS = """
steps AS (
  SELECT event_type AS run, event_id, ts, value, 4 AS batch, length(event_type) % 4 + 1 AS accumulation,
         row_number() OVER w AS step,
         sum(4 * (length(event_type) % 4 + 1)) OVER w AS total_samples,
         min(ts) OVER (PARTITION BY event_type) AS start_ts
  FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def training_speed_sql() -> str:
    return with_views(V_STEPS) + """
SELECT run, CAST(step AS BIGINT) AS step, CAST(total_samples AS BIGINT) AS total_samples,
       round((epoch_us(ts) - epoch_us(start_ts)) / 1e6, 6) AS elapsed_s,
       round(CASE WHEN epoch_us(ts) > epoch_us(start_ts)
                  THEN total_samples / ((epoch_us(ts) - epoch_us(start_ts)) / 1e6) END, 6) AS samples_per_second,
       round((epoch_us(ts) - epoch_us(start_ts)) / 1e6 / step, 6) AS seconds_per_step
FROM steps WHERE step % 10 = 0"""


def run_summary_sql() -> str:
    return """
SELECT event_type AS run, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS total_time_s,
       CAST(count(*) AS BIGINT) AS max_steps, CAST(count(*) AS BIGINT) AS n_rows, max(value) AS peak_memory,
       round(CASE WHEN max(ts) > min(ts) THEN count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) END, 6)
         AS steps_per_second
FROM events GROUP BY event_type"""


def checkpoint_steps_sql() -> str:
    return with_views(V_STEPS) + """
SELECT run, CAST(step AS BIGINT) AS step, event_id FROM steps WHERE step % 100 = 0 AND step > 0"""


# --------------------------------------------------------------- tokens ----

def _vocab_cte(k: int = 997) -> str:
    return f"""
toks AS (SELECT doc_id, regexp_extract_all(text, {q(TOKEN_PATTERN)}) AS t FROM documents),
counts AS (SELECT tok, count(*) AS cnt FROM (SELECT unnest(t) AS tok FROM toks) GROUP BY tok),
vocab AS (
  SELECT tok, CAST(row_number() OVER (ORDER BY cnt DESC, tok) + 2 AS BIGINT) AS id, CAST(cnt AS BIGINT) AS cnt
  FROM counts ORDER BY cnt DESC, tok LIMIT {k})"""


def vocabulary_sql() -> str:
    return with_views(_vocab_cte()) + """
SELECT tok AS token, id, cnt AS count FROM vocab"""


def tokenise_sql() -> str:
    return with_views(_vocab_cte(), """
pos AS (
  SELECT doc_id, unnest(t[1:512]) AS tok, generate_subscripts(t[1:512], 1) AS p FROM toks),
enc AS (
  SELECT pos.doc_id, list(CAST(coalesce(v.id, 1) AS INTEGER) ORDER BY p) AS ids
  FROM pos LEFT JOIN vocab v USING (tok) GROUP BY pos.doc_id),
full_ AS (
  SELECT toks.doc_id, coalesce(enc.ids, []::INTEGER[]) AS ids, len(toks.t) AS n_full
  FROM toks LEFT JOIN enc USING (doc_id))""") + """
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_tokens,
       array_to_string(list_resize(ids, 512, 0), ' ') AS input_ids,
       array_to_string(list_concat(ids, list_transform(range(512 - len(ids)), lambda x: -100)), ' ') AS labels,
       CAST(least(512, 1024 - n_full) AS INTEGER) AS gpt2_new_tokens,
       CAST(least(2048, 4096 - n_full) AS INTEGER) AS deepseek_new_tokens
FROM full_"""


def bpe_roundtrip_sql() -> str:
    return "SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars FROM documents"


# ------------------------------------------------------------ user code ----

def generated_eval_sql() -> str:
    return with_views(V_GOLD, f"""
votes AS (
  SELECT g.question_id, v.vote,
         'The answer is ' || ((length(g.question || {q(ZERO_SHOT_INSTRUCTION)}) + v.vote) % 50 + 1) || '.' AS response
  FROM gold g CROSS JOIN range(4) AS v(vote)),
ext AS (SELECT question_id, vote, {extract_predicted('response')} AS numeric FROM votes),
tally AS (
  SELECT question_id, numeric, count(*) AS c, min(vote) AS first_vote
  FROM ext WHERE numeric IS NOT NULL GROUP BY ALL),
winner AS (
  SELECT question_id, numeric AS majority_answer FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY c DESC, first_vote) AS r FROM tally)
  WHERE r = 1),
per_q AS (SELECT question_id, CAST(count(*) AS BIGINT) AS n_votes FROM ext GROUP BY question_id),
res AS (
  SELECT p.question_id, p.n_votes, w.majority_answer, {extract_answer('g.answer')} AS gold_answer
  FROM per_q p LEFT JOIN winner w USING (question_id) LEFT JOIN gold g USING (question_id))""") + f"""
SELECT question_id, n_votes, majority_answer, gold_answer,
       {is_correct('majority_answer', 'gold_answer')} AS correct
FROM res"""


def user_functions_sql() -> str:
    return """
SELECT doc_id, lang, CAST(length(text) AS BIGINT) AS n_chars,
       CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n_lines
FROM documents WHERE lang IN ('en', 'de')"""


def row_functions_sql() -> str:
    return r"""
SELECT conv_id, turn, CAST(len(regexp_extract_all(coalesce(text, ''), '\S+')) AS BIGINT) AS n_words,
       upper(coalesce(role, '')) AS loud
FROM conversations"""


def cut_inputs_sql() -> str:
    return with_views(_vocab_cte(), """
pos AS (
  SELECT doc_id, unnest(t[1:100]) AS tok, generate_subscripts(t[1:100], 1) AS p FROM toks),
enc AS (
  SELECT pos.doc_id, list(CAST(coalesce(v.id, 1) AS INTEGER) ORDER BY p) AS ids
  FROM pos LEFT JOIN vocab v USING (tok) GROUP BY pos.doc_id)""") + """
SELECT toks.doc_id, CAST(len(toks.t) AS INTEGER) AS n_input,
       array_to_string(coalesce(enc.ids, []::INTEGER[]), ' ') AS cut_ids
FROM toks LEFT JOIN enc USING (doc_id)"""


def repeated_key_sample_sql() -> str:
    return """
WITH h AS (SELECT l_orderkey, md5('42:' || l_orderkey) AS h, floor(count(*) OVER () * 0.05) AS n FROM lineitem),
r AS (SELECT *, row_number() OVER (ORDER BY h, l_orderkey) AS p FROM h)
SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_orders, max(h) AS last_hash FROM r WHERE p <= n"""


def lineitem_split_flags_sql() -> str:
    return """
WITH h AS (
  SELECT l_linestatus, md5('42:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey) AS h,
         count(*) OVER (PARTITION BY l_linestatus) AS n FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY h) <= ceil(0.1 * n) AS test FROM h)
SELECT l_linestatus, count(*) AS n, count(*) FILTER (WHERE test) AS n_test, max(h) FILTER (WHERE test) AS last_hash
FROM r GROUP BY l_linestatus"""


# -------------------------------------------------------------- sources ----

def qa_jsonl_roundtrip_sql() -> str:
    return """
SELECT item_id AS qid, 'train' AS split, text AS question, '#### ' || item_id AS answer FROM benchmark
UNION ALL
SELECT doc_id, 'test', text, '#### ' || doc_id FROM documents"""


POSITION = "CAST(row_number() OVER (PARTITION BY dataset ORDER BY row_key) - 1 AS BIGINT) AS row_key"


def _rendered_sql(where: str, cols: str = f"{POSITION}, text") -> str:
    """Rendered rows of the problems read back from files: their key is the
    position in the source."""
    return with_views(V_PROBLEMS, V_RENDERED) + f"\nSELECT {cols} FROM rendered WHERE {where}"


def asdiv_xml_roundtrip_sql() -> str:
    return _rendered_sql("dataset = 'ASDiv' AND row_key % 17 <> 0")


def json_array_roundtrip_sql() -> str:
    return _rendered_sql("dataset IN ('ParaMAWPS', 'SVAMP')", f"dataset, {POSITION}, text")


def keyed_json_roundtrip_sql() -> str:
    return _rendered_sql("dataset = 'DMath'")


def aqua_jsonl_roundtrip_sql() -> str:
    return with_views(V_PROBLEMS, V_RENDERED, V_STANDARD) + f"""
SELECT {POSITION}, text, question, answer FROM standard WHERE dataset = 'AQuA'"""


def leaderboard_csv_roundtrip_sql() -> str:
    return leaderboard_zoom_sql().replace(
        "SELECT p_partkey AS row_key", "SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS row_key")


def curriculum_files_sql() -> str:
    return curriculum_splits_sql().replace(
        "p_partkey AS pid", "CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS pid")


def curriculum_rejects_sql() -> str:
    return f"SELECT dataset, n_raw, n_raw - n_kept AS n_dropped FROM ({curriculum_counts_sql()})"


def saved_splits_sql() -> str:
    return f"SELECT * FROM ({curriculum_splits_sql()}) WHERE split = 'test'"


def results_files_sql() -> str:
    return _vote_results() + f""",
r AS (
  SELECT run, question_id, n_votes, majority_answer, gold_answer,
         {is_correct('majority_answer', 'gold_answer')} AS correct FROM res),
acc AS (
  SELECT run, round(sum(CASE WHEN correct THEN 1 ELSE 0 END) / (SELECT count(*) FROM gold), 6) AS accuracy
  FROM r GROUP BY run)
SELECT r.*, acc.accuracy FROM r LEFT JOIN acc USING (run)"""


def collect_votes_sql() -> str:
    order = "ORDER BY l_linenumber, l_partkey, l_suppkey"
    return with_views(V_RESPONSES) + f"""
SELECT run, question_id, chunk,
       string_agg(response, ' | ' {order}) AS model_answers_text,
       string_agg(coalesce(CAST(numeric AS VARCHAR), 'null'), ',' {order}) AS extracted_model_answers
FROM (SELECT *, {extract_answer('response')} AS numeric,
             (row_number() OVER (PARTITION BY run, question_id {order}) - 1) // 4 AS chunk FROM responses)
GROUP BY run, question_id, chunk"""


def dataset_sizes_sql() -> str:
    return with_views(V_PROBLEMS, V_RENDERED, V_STANDARD, """
cnt AS (
  SELECT dataset, CAST(sum(CASE WHEN question IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_kept
  FROM standard GROUP BY dataset)""") + """
SELECT n.dataset, n.stage, c.n_kept
FROM (VALUES ('ASDiv', 1), ('ParaMAWPS', 2), ('SVAMP', 3), ('DMath', 4), ('AQuA', 5)) AS n(dataset, stage)
LEFT JOIN cnt c USING (dataset)"""


def dataset_profile_sql() -> str:
    return f"""
WITH s AS ({corpus_split_sql()}),
first5 AS (
  SELECT split, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS sample_keys,
         '[' || string_agg(to_json(struct_pack(doc_id := doc_id, lang := lang, shuffle_pos := shuffle_pos, split := split)),
                           ',' ORDER BY doc_id) || ']' AS sample_rows
  FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS rn FROM s)
  WHERE rn <= 5 GROUP BY split)
SELECT s.split, CAST(count(*) AS BIGINT) AS num_examples, f.sample_keys, f.sample_rows,
       'doc_id,lang,shuffle_pos,split' AS column_names,
       'struct<doc_id:bigint,lang:string,shuffle_pos:bigint,split:string>' AS features
FROM s JOIN first5 f USING (split) GROUP BY s.split, f.sample_keys, f.sample_rows"""


# ------------------------------------------------------------ streaming ----

def stream_corpus_filter_sql() -> str:
    return f"""
SELECT doc_id, source, CAST(len(regexp_extract_all(text, {q(TOKEN_PATTERN)})) AS INTEGER) AS n_tokens,
       md5('Instruction' || {NL} || coalesce(lang, '') || {NL} || 'Response' || {NL} || coalesce(text, '')) AS prompt_md5
FROM documents WHERE source IS NOT NULL AND NOT starts_with(source, 'src1')"""


def stream_shuffle_sql() -> str:
    """The buffer replayed: a record leaves its slot when the next one draws it."""
    return """
WITH p AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents),
s AS (
  SELECT *, CASE WHEN position < 64 THEN position
                 ELSE CAST('0x' || substr(md5('42:' || position), 1, 8) AS BIGINT) % 64 END AS slot
  FROM p),
e AS (SELECT *, lead(position) OVER (PARTITION BY slot ORDER BY position) - 64 AS out FROM s)
SELECT doc_id, lang, CAST(position AS BIGINT) AS position,
       CAST(coalesce(out, count(out) OVER () + row_number() OVER (PARTITION BY out IS NULL ORDER BY md5('42:end:' || slot)) - 1)
            AS BIGINT) AS shuffle_pos
FROM e"""


def stream_head_sql() -> str:
    return "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100"


def stream_source_counts_sql() -> str:
    return "SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY source"


def stream_accuracy_sql() -> str:
    return with_views(V_RESPONSES, V_GOLD, f"""
judged AS (
  SELECT r.run, {is_correct(extract_answer('r.response'), extract_answer('g.answer'))} AS ok
  FROM responses r LEFT JOIN gold g USING (question_id))""") + """
SELECT run, CAST(count(*) AS BIGINT) AS n_total, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
       round(sum(CASE WHEN ok THEN 1 ELSE 0 END) / count(*), 6) AS accuracy
FROM judged GROUP BY run"""


def stream_training_speed_sql() -> str:
    return """
SELECT event_type AS run, CAST(count(*) AS BIGINT) AS n_steps,
       CAST(sum(4 * (length(event_type) % 4 + 1)) AS BIGINT) AS total_samples,
       round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS elapsed_s,
       round(CASE WHEN max(ts) > min(ts)
                  THEN sum(4 * (length(event_type) % 4 + 1)) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) END, 6)
         AS samples_per_second
FROM events GROUP BY event_type"""


def eight_shot_eval_sql() -> str:
    head, tail = EIGHT_SHOT_PROMPT.split("{question}")
    decoded = (f"({q(head)} || 'How much is order ' || question_id || '?' || {q(tail)} || ' ' || response "
               f"|| {NL} || {NL} || 'Q: next question')")
    last_a = strip(f"string_split({decoded}, 'A:')[-1]")
    cut = (f"CASE WHEN len(string_split({decoded}, 'A:')) > 1 THEN (CASE WHEN contains({last_a}, 'Q:') "
           f"THEN {strip(f'string_split({last_a}, {q(chr(81) + chr(58))})[1]')} ELSE {last_a} END) ELSE '' END")
    return with_views(V_RESPONSES, V_GOLD, f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run, question_id ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos
  FROM responses),
ext AS (SELECT run, question_id, pos, {extract_predicted(f'({cut})')} AS numeric FROM ranked WHERE pos <= 8),
tally AS (
  SELECT run, question_id, numeric, count(*) AS c, min(pos) AS first_pos
  FROM ext WHERE numeric IS NOT NULL GROUP BY ALL),
winner AS (
  SELECT run, question_id, numeric AS majority_answer FROM (
    SELECT *, row_number() OVER (PARTITION BY run, question_id ORDER BY c DESC, first_pos) AS r FROM tally)
  WHERE r = 1),
per_q AS (SELECT DISTINCT run, question_id FROM ext),
res AS (
  SELECT p.run, {is_correct('w.majority_answer', extract_answer('g.answer'))} AS ok
  FROM per_q p LEFT JOIN winner w USING (run, question_id) LEFT JOIN gold g ON g.question_id = p.question_id)""") + """
SELECT run, (SELECT count(*) FROM gold) AS n_total, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
       round(sum(CASE WHEN ok THEN 1 ELSE 0 END) / (SELECT count(*) FROM gold), 6) AS accuracy
FROM res GROUP BY run"""


def corpus_split_flags_sql() -> str:
    return """
SELECT doc_id, lang, CASE WHEN pos < ceil(0.1 * n) THEN 'test' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) - 1 AS pos,
             count(*) OVER (PARTITION BY lang) AS n FROM documents)"""


def multiple_choice_prompts_sql() -> str:
    return with_views(V_PROBLEMS) + f"""
SELECT pid, {_t('question')} || ' ' || {NL} || ' Options:' || {NL}
       || array_to_string(list_transform(options, lambda o, i: ' ' || chr(CAST(96 + i AS INTEGER)) || ') ' || o || {NL}), '')
       AS prompt
FROM problems"""


def stream_source_peek_sql() -> str:
    return """
SELECT source, CAST(count(*) AS BIGINT) AS n FROM (SELECT source FROM documents ORDER BY doc_id LIMIT 400) GROUP BY source"""


def curriculum_tokens_sql() -> str:
    return f"""
WITH splits AS ({curriculum_splits_sql()}),
toks AS (SELECT dataset, row_key, split, regexp_extract_all(prompt, {q(TOKEN_PATTERN)}) AS t FROM splits),
counts AS (SELECT tok, count(*) AS cnt FROM (SELECT unnest(t) AS tok FROM toks) GROUP BY tok),
vocab AS (
  SELECT tok, row_number() OVER (ORDER BY cnt DESC, tok) + 2 AS id
  FROM counts ORDER BY cnt DESC, tok LIMIT 997),
pos AS (
  SELECT dataset, row_key, unnest(t[1:512]) AS tok, generate_subscripts(t[1:512], 1) AS p FROM toks),
enc AS (
  SELECT pos.dataset, pos.row_key, list(CAST(coalesce(v.id, 1) AS INTEGER) ORDER BY p) AS ids
  FROM pos LEFT JOIN vocab v USING (tok) GROUP BY pos.dataset, pos.row_key)
SELECT toks.dataset, toks.row_key, toks.split, CAST(len(coalesce(enc.ids, [])) AS INTEGER) AS n_tokens,
       array_to_string(coalesce(enc.ids, []::INTEGER[]), ' ') AS input_ids, CAST(len(toks.t) AS INTEGER) AS n_input
FROM toks LEFT JOIN enc ON enc.dataset = toks.dataset AND enc.row_key = toks.row_key"""


def stream_tokenise_sql() -> str:
    return with_views(_vocab_cte(), """
pos AS (
  SELECT doc_id, unnest(t[1:1024]) AS tok, generate_subscripts(t[1:1024], 1) AS p FROM toks),
enc AS (
  SELECT pos.doc_id, list(CAST(coalesce(v.id, 1) AS INTEGER) ORDER BY p) AS ids
  FROM pos LEFT JOIN vocab v USING (tok) GROUP BY pos.doc_id),
full_ AS (
  SELECT toks.doc_id, coalesce(enc.ids, []::INTEGER[]) AS ids FROM toks LEFT JOIN enc USING (doc_id))""") + """
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_tokens,
       array_to_string(list_resize(ids, 1024, 0), ' ') AS input_ids,
       array_to_string(list_concat(ids, list_transform(range(1024 - len(ids)), lambda x: -100)), ' ') AS labels
FROM full_"""


def parquet_footer_rows_sql() -> str:
    return """
SELECT 'documents' AS "table", CAST(count(*) AS BIGINT) AS num_rows FROM documents
UNION ALL SELECT 'lineitem', CAST(count(*) AS BIGINT) FROM lineitem
UNION ALL SELECT 'conversations', CAST(count(*) AS BIGINT) FROM conversations"""


def parquet_row_groups_sql() -> str:
    return f"SELECT *, num_rows > 0 AS has_row_groups FROM ({parquet_footer_rows_sql()})"


def stream_running_accuracy_sql() -> str:
    ok = "CASE WHEN correct THEN 1 ELSE 0 END"
    return with_views(V_RESPONSES, V_GOLD, f"""
judged AS (
  SELECT r.run, r.question_id, r.l_linenumber, r.l_partkey, r.l_suppkey,
         {is_correct(extract_answer('r.response'), extract_answer('g.answer'))} AS correct
  FROM responses r LEFT JOIN gold g USING (question_id))""") + f"""
SELECT run, question_id, l_linenumber, l_partkey, l_suppkey, correct,
       CAST(row_number() OVER w - 1 AS BIGINT) AS example_idx,
       CAST(sum({ok}) OVER w AS BIGINT) AS running_correct,
       round(sum({ok}) OVER w / row_number() OVER w, 6) AS running_accuracy
FROM judged
WINDOW w AS (PARTITION BY run ORDER BY question_id, l_linenumber, l_partkey, l_suppkey
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def stream_training_speed_steps_sql() -> str:
    return training_speed_sql()
