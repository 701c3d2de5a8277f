"""Answer extraction and comparison (I1-I13) as Column -> Column functions.

All rules are built-in Spark expressions (regex, arrays, higher-order
functions), so they run inside whole-stage codegen on the executors and never
cross into a Python worker.

Regexes use Java syntax.  ``\\d`` matches ASCII digits only (Python's also
matches other scripts' digits); this is a stated deviation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mathtide.functions.text import col_of, piece, py_strip, quote_regex

# ---------------------------------------------------------------------------
# Fixed values (must equal the evaluated rules for identical results)
# ---------------------------------------------------------------------------
# Number as found by the '####' / end-marker / last-number rules.
NUMBER = r"[-+]?\d*\.?\d+"
# Number after "The answer is" and the unsigned fallback number.
ANSWER_IS = r"The answer is\s+(\d+\.?\d*|\d*\.\d+)"
UNSIGNED_NUMBER = r"(\d+\.?\d*|\d*\.\d+)"
# Characters deleted before extraction: currency symbols and thousands commas.
CURRENCY_CHARS = r"[$€£¥,]"
# Unit words removed after a number, tried in this order; no word boundary.
UNIT_WORDS = [
    "dollars", "USD", "euros", "EUR", "pounds", "GBP", "yen", "JPY", "yuan", "CNY",
    "rupees", "INR", "%", "percent", "units", "kg", "g", "mg", "m", "cm", "mm", "km",
    "mph", "lbs", "oz", "inches", "feet", "ft", "tons", "hours", "hrs", "minutes",
    "mins", "seconds", "secs",
]
# Keyword answer rule of the benchmark-harness adapter (case-insensitive).
KEYWORD_ANSWER = (r"(?i)(?:answer|result|total|sum)(?:\s+is|\s*=|\s*:)\s*(\d+\.?\d*)"
                  r"|(\d+\.?\d*)(?:\s*is the answer)")
END_OF_TEXT = "<|endoftext|>"
ANSWER_MARK = "####"
# Generation stop strings of the 8-shot evaluation.
STOP_STRINGS = ["Q:", "</s>", "<|im_end|>"]
# Model kinds whose decoded output is cut after the last "Answer:".
CHAT_KINDS = ["llama", "deepseek", "qwen"]
# ---------------------------------------------------------------------------

UNITS_AFTER_NUMBER = r"(\d+)\s*(?:" + "|".join(UNIT_WORDS) + ")"


def clean_number_text(c) -> Column:
    """Drop currency symbols and commas, then unit words after digits."""
    no_currency = F.regexp_replace(col_of(c), CURRENCY_CHARS, "")
    return F.regexp_replace(no_currency, UNITS_AFTER_NUMBER, "$1")


def _numbers(c, pattern: str = NUMBER, group: int = 0) -> Column:
    return F.regexp_extract_all(col_of(c), F.lit(pattern), group)


def _first(arr: Column) -> Column:
    return F.get(arr, 0)


def _last(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(-1))


def _to_double(c: Column) -> Column:
    return c.try_cast("double")


def extract_answer(c, eos: str | None = None) -> Column:
    """Numeric answer of a response or of a gold solution.

    (0) cut at ``eos`` if given and present; (1) after the last '####', cleaned,
    first number; (2) end-of-text parts walked from the end, first part with a
    number gives its first number; (3) last number of the cleaned text.

    Cleaning only deletes characters and unit words right after digits, so no
    change crosses a '####' or end-of-text marker: the '####' branch cleans
    just the tail it reads, and the whole text is cleaned only when that
    branch finds nothing (branches are evaluated lazily, in order).
    """
    t = col_of(c)
    if eos:
        t = F.when(t.contains(eos), py_strip(piece(t, eos, 0))).otherwise(t)
    after_mark = clean_number_text(F.split_part(t, F.lit(ANSWER_MARK), F.lit(-1)))
    by_mark = F.when(t.contains(ANSWER_MARK), _first(_numbers(after_mark)))
    cleaned = clean_number_text(t)
    parts = F.reverse(F.split(cleaned, quote_regex(END_OF_TEXT)))
    found = F.filter(F.transform(parts, lambda p: _numbers(p)), lambda a: F.size(a) > 0)
    by_end_marker = F.when(t.contains(END_OF_TEXT), _first(_first(found)))
    by_last = _last(_numbers(cleaned))
    return _to_double(F.coalesce(by_mark, by_end_marker, by_last))


def extract_answer_plain(c) -> Column:
    """I3: '####' then first number, else last number; no cleaning, no end marker."""
    t = col_of(c)
    after_mark = F.split_part(t, F.lit(ANSWER_MARK), F.lit(-1))
    by_mark = F.when(t.contains(ANSWER_MARK), _first(_numbers(after_mark)))
    return _to_double(F.coalesce(by_mark, _last(_numbers(t))))


def extract_predicted_answer(c, fallback: bool = True) -> Column:
    """I4: first 'The answer is N'; with ``fallback`` the last unsigned number."""
    t = col_of(c)
    said = F.nullif(F.regexp_extract(t, ANSWER_IS, 1), F.lit(""))
    if fallback:
        said = F.coalesce(said, _last(_numbers(t, UNSIGNED_NUMBER, 1)))
    return _to_double(said)


def extract_ground_truth(c) -> Column:
    """I5: 'The answer is N' only (no fallback)."""
    return extract_predicted_answer(c, fallback=False)


def extract_keyword_answer(c) -> Column:
    """First non-empty group of the keyword rule, else the whole text."""
    t = col_of(c)
    g1 = F.nullif(F.regexp_extract(t, KEYWORD_ANSWER, 1), F.lit(""))
    g2 = F.nullif(F.regexp_extract(t, KEYWORD_ANSWER, 2), F.lit(""))
    return F.coalesce(g1, g2, t)


# Python float() grammar: optional sign, digits with single underscores between
# them, optional fraction and exponent, or inf/infinity/nan in any case.
_DIGITS = r"\d(?:_?\d)*"
_PY_FLOAT = (r"^[-+]?(?:(?:" + _DIGITS + r"(?:\.(?:" + _DIGITS + r")?)?|\." + _DIGITS + r")"
             r"(?:[eE][-+]?" + _DIGITS + r")?|(?i:inf|infinity|nan))$")


def to_number(c) -> Column:
    """struct(value double, is_whole boolean, raw string).

    ``value`` is null when the text is not a Python float literal; ``is_whole``
    marks values the reference would turn into an int.
    """
    raw = col_of(c)
    s = py_strip(raw)
    value = F.when(s.rlike(_PY_FLOAT), F.regexp_replace(s, "_", "").cast("double"))
    return F.struct(value.alias("value"), is_whole(value).alias("is_whole"), raw.alias("raw"))


def is_whole(v) -> Column:
    v = col_of(v)
    return F.coalesce((F.floor(v) == v) & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))),
                      F.lit(False))


def is_correct(pred, gold) -> Column:
    """I8: whole numbers compare exactly, others within 1 % relative error."""
    p, g = col_of(pred), col_of(gold)
    rel = F.abs(p - g) / (F.abs(g) + F.lit(1e-10))
    res = F.when(is_whole(p) & is_whole(g), p == g).otherwise(rel < F.lit(0.01))
    return F.coalesce(F.when(p.isNotNull() & g.isNotNull(), res), F.lit(False))


def closeness(pred, gold) -> Column:
    """I9: 'correct' / 'incorrect' within 1e-6, 'no_answer' when either is null."""
    p, g = col_of(pred), col_of(gold)
    return (F.when(p.isNull() | g.isNull(), F.lit("no_answer"))
            .when(F.abs(p - g) < F.lit(1e-6), F.lit("correct"))
            .otherwise(F.lit("incorrect")))


def is_exact(pred, gold) -> Column:
    """Float equality, null on either side -> false."""
    return F.coalesce(col_of(pred) == col_of(gold), F.lit(False))


def post_process_response(c) -> Column:
    """Keep text before the first '####', the mark, and what follows up to
    the next '####' or blank line."""
    t = col_of(c)
    head = piece(t, ANSWER_MARK, 0)
    nxt = piece(t, ANSWER_MARK, 1)
    kept = F.concat(head, F.lit(ANSWER_MARK), piece(nxt, "\n\n", 0))
    return F.when(t.contains(ANSWER_MARK), kept).otherwise(t)


def completion_text(response, prompt=None, kind: str | Column = "default") -> Column:
    """The newly generated part of a decoded response.

    Chat kinds keep what follows the last 'Answer:'; other kinds drop
    ``len(prompt)`` characters.  Both are stripped.
    """
    r = col_of(response)
    after_answer = py_strip(piece(r, "Answer:", -1))
    if prompt is None:
        dropped = py_strip(r)
    else:
        dropped = py_strip(F.substring(r, F.length(col_of(prompt)) + 1, F.lit(2147483647)))
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(k.isin(*CHAT_KINDS), after_answer).otherwise(dropped)


def completion_after_last_a(response, cut_at_question: bool = True) -> Column:
    """I12, 8-shot form: text after the last 'A:' (stripped), '' without one;
    with ``cut_at_question`` cut at the first 'Q:' and strip again."""
    r = col_of(response)
    out = py_strip(piece(r, "A:", -1))
    if cut_at_question:
        out = F.when(out.contains("Q:"), py_strip(piece(out, "Q:", 0))).otherwise(out)
    return F.when(r.contains("A:"), out).otherwise(F.lit(""))


def cut_at_stop(c, stops=None) -> Column:
    """Generated text up to the first stop string (on finished text)."""
    stops = stops or STOP_STRINGS
    pattern = "|".join(quote_regex(s) for s in stops)
    return F.get(F.split(col_of(c), pattern), 0)
