"""Record and prompt shaping (B1-B12, B16-B18) as column expressions.

Renderers turn source fields into the reference's one-text-per-problem form;
standardisers split that text back into (question, answer) and give null when
a piece is missing, which is how a failing formatter drops a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathtide.functions.text import col_of, excerpt, piece, py_strip, quote_regex  # noqa: F401 (re-exported)

# ---------------------------------------------------------------------------
# Prompt templates and instructions used by the evaluations.
# ---------------------------------------------------------------------------
SOLVE_PREFIX = "Let me solve this step by step.\n"
SOLVE_SUFFIX_HEAD = "\nTherefore, the answer is "
FEW_SHOT_INSTRUCTION = ("Answer: Let's solve this step by step. I'll write the final answer "
                        "after ####.\n")
THINK_INSTRUCTION = ("Let's think step by step. At the end, you MUST write the answer as an "
                     "integer after '####'. Ensure your answer is fully written before stopping.\n")
ZERO_SHOT_INSTRUCTION = ("Let's solve it step by step. Make sure to stop immediately after writing "
                         "the final answer. You MUST write the final answer as an integer after '####'.")
CHAT_ZERO_SHOT_INSTRUCTION = ("Let's solve it step by step. You must give your final answer as an "
                              "integer after '####'")
STEP_BY_STEP_HEAD = "Solve this step-by-step:\n"
STEP_BY_STEP_TAIL = "\n\nThink through this carefully:\n1. "
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
# Chat template (ChatML form) used when a conversation becomes one prompt.
CHAT_TURN = "<|im_start|>{role}\n{content}<|im_end|>\n"
CHAT_GENERATION_MARK = "<|im_start|>assistant\n"
# ---------------------------------------------------------------------------

PROMPT_STYLES = ("question", "shots_only", "shots_then_question", "eight_shot", "zero_shot",
                 "chat_zero_shot", "step_by_step", "multiple_choice")


def _s(c) -> Column:
    return F.coalesce(col_of(c).cast("string"), F.lit(""))


# --------------------------------------------------------------- renderers --

def render_asdiv(body, question, answer, formula) -> Column:
    """B1: 'Question: [body ]q\\n[Solution: f\\n]Answer: a' (fields stripped)."""
    b, q, a, f = (py_strip(_s(c)) for c in (body, question, answer, formula))
    lead = F.when(b != "", F.concat(b, F.lit(" "))).otherwise(F.lit(""))
    sol = F.when(f != "", F.concat(F.lit("Solution: "), f, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("Question: "), lead, q, F.lit("\n"), sol, F.lit("Answer: "), a)


def render_paramawps(original_text, equation, ans) -> Column:
    """B2: 'Question: ..\\nEquation: ..\\nAnswer: ..' (always with the equation)."""
    q, e, a = (py_strip(_s(c)) for c in (original_text, equation, ans))
    return F.concat(F.lit("Question: "), q, F.lit("\nEquation: "), e, F.lit("\nAnswer: "), a)


def render_svamp(body, question, equation, answer) -> Column:
    """Body + ' ' + question stripped; equation line only when non-empty."""
    q = py_strip(F.concat(_s(body), F.lit(" "), _s(question)))
    e, a = py_strip(_s(equation)), py_strip(_s(answer))
    eq = F.when(e != "", F.concat(F.lit("\nEquation: "), e)).otherwise(F.lit(""))
    return F.concat(F.lit("Question: "), q, eq, F.lit("\nAnswer: "), a)


def render_dmath(question_en, solution_code_en, answer_en) -> Column:
    """B4: 'Question: ..\\nSolution: ..\\nAnswer: ..' from the English fields."""
    q, s, a = (py_strip(_s(c)) for c in (question_en, solution_code_en, answer_en))
    return F.concat(F.lit("Question: "), q, F.lit("\nSolution: "), s, F.lit("\nAnswer: "), a)


def render_aqua(question, options, rationale, correct) -> Column:
    """Options lettered 'A. ', 'B. ', ... one per line, then rationale and answer."""
    q, r = py_strip(_s(question)), py_strip(_s(rationale))
    opts = F.coalesce(col_of(options), F.array().cast("array<string>"))
    lettered = F.array_join(F.transform(opts, lambda o, i: F.concat(
        F.char(F.lit(65) + i), F.lit(". "), F.coalesce(o, F.lit("None")), F.lit("\n"))), "")
    return F.concat(F.lit("Question: "), q, F.lit("\nOptions:\n"), lettered,
                    F.lit("Rationale: "), r, F.lit("\nAnswer: "), _s(correct))


# ------------------------------------------------------------ standardise --

def _solved(solution: Column, answer: Column) -> Column:
    return F.concat(F.lit(SOLVE_PREFIX), solution, F.lit(SOLVE_SUFFIX_HEAD), answer, F.lit("."))


def standardise(text, solution_key: str) -> Column:
    """struct(question, answer) from rendered text; null when a piece is missing.

    Only the piece between the first and a second 'Question: ' is used, and
    only pieces 0 and 1 around '\\nAnswer:' (Q2).
    """
    body = piece(text, "Question: ", 1)
    q_part = piece(body, f"\n{solution_key}:", 0)
    rest = piece(body, f"\n{solution_key}:", 1)
    solution = piece(rest, "\nAnswer:", 0)
    answer = piece(rest, "\nAnswer:", 1)
    ok = q_part.isNotNull() & solution.isNotNull() & answer.isNotNull()
    return F.when(ok, F.struct(py_strip(q_part).alias("question"),
                               _solved(py_strip(solution), py_strip(answer)).alias("answer")))


def standardise_aqua(text, last_answer: bool = False) -> Column:
    """AQuA text to struct(question, answer); missing rationale/answer -> ''.

    By default the answer is the piece after the *first* 'Answer:' (Q3);
    ``last_answer=True`` takes the last one instead.
    """
    t = col_of(text)
    q_part = py_strip(piece(piece(t, "Question: ", 1), "Rationale:", 0))
    opt_head = py_strip(piece(q_part, "Options:", 0))
    opt_tail = py_strip(piece(q_part, "Options:", 1))
    question = F.when(q_part.contains("Options:"),
                      F.concat(opt_head, F.lit("\nOptions:\n"), opt_tail)).otherwise(q_part)
    rationale = F.when(t.contains("Rationale:"),
                       py_strip(piece(piece(t, "Rationale:", 1), "Answer:", 0))).otherwise(F.lit(""))
    ans_piece = piece(t, "Answer:", -1 if last_answer else 1)
    answer = F.when(t.contains("Answer:"), py_strip(ans_piece)).otherwise(F.lit(""))
    return F.when(q_part.isNotNull(), F.struct(question.alias("question"),
                                               _solved(rationale, answer).alias("answer")))


# ----------------------------------------------------------------- prompts --

def sft_prompt(question, answer) -> Column:
    """B8: '###Question: {q}\\n###Answer: {a}'."""
    return F.concat(F.lit("###Question: "), _s(question), F.lit("\n###Answer: "), _s(answer))


def instruction_prompt(instruction, output) -> Column:
    """B9: 'Instruction\\n{instruction}\\nResponse\\n{output}'."""
    return F.concat(F.lit("Instruction\n"), _s(instruction), F.lit("\nResponse\n"), _s(output))


def chat_prompt(turns: DataFrame, conversation: str = "conv_id", order: str = "turn",
                role: str = "role", content: str = "text", turn_template: str = CHAT_TURN,
                generation_mark: str = CHAT_GENERATION_MARK) -> DataFrame:
    """A conversation's turns, in order, as one prompt with a generation mark.

    One output row is one conversation, so its turns meet in one task; the
    partial aggregate keeps only (order, rendered turn) pairs before the
    shuffle.
    """
    head, rest = turn_template.split("{role}", 1)
    mid, tail = rest.split("{content}", 1)
    rendered = F.concat(F.lit(head), F.col(role), F.lit(mid), F.col(content), F.lit(tail))
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), rendered.alias("t"))))
    return (turns.groupBy(conversation)
            .agg(packed.alias("__turns"), F.count(F.lit(1)).alias("n_turns"))
            .select(conversation, "n_turns",
                    F.concat(F.array_join(F.transform("__turns", lambda x: x["t"]), ""),
                             F.lit(generation_mark)).alias("prompt")))


def shot_text(question, answer) -> Column:
    """One shot of the chain-of-thought block."""
    return F.concat(F.lit("Question: "), _s(question), F.lit("\nAnswer: "), _s(answer), F.lit("\n\n"))


def few_shot_block(shots: DataFrame, order: str | Sequence[str], question: str = "question",
                   answer: str = "answer") -> DataFrame:
    """One row, the shots laid out in draw order.

    ``shots`` is a seeded sample of n rows (n a small parameter, so the single
    group is bounded by n); ``order`` names its draw-order column(s), e.g. the
    kept hash and the key from ``sample_n(..., order_col=...)``, or a rank.
    """
    order = [order] if isinstance(order, str) else list(order)
    key = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    packed = F.array_sort(F.collect_list(F.struct(key.alias("r"), shot_text(question, answer).alias("t"))))
    return shots.agg(F.array_join(F.transform(packed, lambda x: x["t"]), "").alias("shots"))


def multiple_choice_text(question, options) -> Column:
    """B12 multiple-choice form: '{q} \n Options:\n a) ..\n b) ..\n'."""
    opts = F.coalesce(col_of(options), F.array().cast("array<string>"))
    lettered = F.array_join(F.transform(opts, lambda o, i: F.concat(
        F.lit(" "), F.char(F.lit(97) + i), F.lit(") "), F.coalesce(o, F.lit("None")), F.lit("\n"))), "")
    return F.concat(_s(question), F.lit(" \n Options:\n"), lettered)


def eval_prompt(question, style: str = "question", shots: Column | None = None,
                options: Column | None = None) -> Column:
    """Evaluation prompt for a test question.

    Styles: 'question' (shots, question, instruction), 'shots_only' (shots and
    instruction without the question, Q4), 'shots_then_question', 'eight_shot'
    (fixed 8 worked examples), 'zero_shot', 'chat_zero_shot', 'step_by_step',
    'multiple_choice' (needs ``options``).
    ``shots`` is the block column, e.g. ``few_shot_block(...).scalar()``.
    """
    q = _s(question)
    s = shots if shots is not None else F.lit("")
    if style == "question":
        return F.concat(s, F.lit("Question: "), q, F.lit("\n"), F.lit(FEW_SHOT_INSTRUCTION))
    if style == "shots_only":
        return F.concat(F.lit("Question: "), s, F.lit(" "), F.lit(THINK_INSTRUCTION))
    if style == "shots_then_question":
        return F.concat(F.lit("\n"), s, F.lit("\n\nQuestion: "), q, F.lit("\n"), F.lit(THINK_INSTRUCTION))
    if style == "eight_shot":
        head, tail = EIGHT_SHOT_PROMPT.split("{question}")
        return F.concat(F.lit(head), q, F.lit(tail))
    if style == "zero_shot":
        return F.concat(q, F.lit(ZERO_SHOT_INSTRUCTION))
    if style == "chat_zero_shot":
        return F.concat(q, F.lit(CHAT_ZERO_SHOT_INSTRUCTION))
    if style == "step_by_step":
        return F.concat(F.lit(STEP_BY_STEP_HEAD), q, F.lit(STEP_BY_STEP_TAIL))
    if style == "multiple_choice":
        return multiple_choice_text(q, options)
    raise ValueError(f"unknown prompt style {style!r}; expected one of {PROMPT_STYLES}")


def attach_shots(test: DataFrame, block: DataFrame, question: str = "question",
                 style: str = "question", out: str = "prompt") -> DataFrame:
    """The same shot block before every test question.

    The one-row block is a scalar subquery: computed once, then a literal in
    the projection -- no join, no broadcast of anything that grows.
    """
    return test.withColumn(out, eval_prompt(F.col(question), style, block.scalar()))


# ------------------------------------------------------------------- misc --

def prune_columns(df: DataFrame, *cols: str) -> DataFrame:
    """Drop columns after mapping (the scan then skips them)."""
    return df.drop(*cols)


def require_columns(df: DataFrame, *cols: str) -> DataFrame:
    """Fail early, naming the available columns, if one is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"{missing[0]!r} column not found. Available columns: {df.columns}")
    return df
