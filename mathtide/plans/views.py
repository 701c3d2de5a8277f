"""Deterministic word-problem shaped views over the driver tables (V1-V7).

The driver tables hold invented prose with no maths, so the registered
queries run on views derived from them.  Each view grows with its base table
and is written with built-in expressions only; ``oracle.py`` restates the
same rules in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathtide.session import read_table, spread


_LINEITEM_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_linestatus"]


def _s(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: one model response per lineitem (see ``responses_from``)."""
    raw = read_table(spark, sf_dir, "lineitem").select(*_LINEITEM_COLUMNS)
    return responses_from(spread(raw))     # spread the narrow raw columns, then derive


def responses_from(lineitem: DataFrame, *carry: str) -> DataFrame:
    """V1 over a lineitem frame (batch or stream), with the columns of ``carry``.

    run = l_linestatus, question_id = l_orderkey, the vote position is
    (l_linenumber, l_partkey, l_suppkey) -- as a struct ``vote`` and packed in
    ``vote_pos``; the text form depends on l_partkey % 6.
    """
    li = lineitem.select(*_LINEITEM_COLUMNS, *carry)
    n = F.floor("l_quantity").cast("long")
    m = F.col("l_suppkey") % 10
    kind = F.col("l_partkey") % 6
    text = (F.when(kind == 0, F.concat(F.lit("Adding up gives "), _s(n), F.lit(" apples. #### $"), _s(n)))
            .when(kind == 1, F.concat(F.lit("Thus it is #### 1,00"), _s(n)))
            .when(kind == 2, F.concat(F.lit("We get "), _s(n), F.lit(" - "), _s(m),
                                      F.lit(". The answer is "), _s(n), F.lit(".")))
            .when(kind == 3, F.concat(_s(n), F.lit("<|endoftext|>"), _s(m), F.lit(" dollars")))
            .when(kind == 4, F.concat(F.lit("total = "), _s(n), F.lit(" kg")))
            .otherwise(F.lit("I am not sure.")))
    # the vote position packed into one decimal: line * 10^24 + part * 10^12 + supplier
    pos = (F.col("l_linenumber").cast("decimal(27,0)") * F.lit("1" + "0" * 24).cast("decimal(27,0)")
           + F.col("l_partkey").cast("decimal(27,0)") * F.lit("1" + "0" * 12).cast("decimal(27,0)")
           + F.col("l_suppkey").cast("decimal(27,0)")).cast("decimal(27,0)")
    return li.select(
        F.col("l_linestatus").alias("run"),
        F.col("l_orderkey").alias("question_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("vote"),
        pos.alias("vote_pos"),
        text.alias("response"), *carry)


def gold(spark: SparkSession, sf_dir: str, rebalance: bool = True) -> DataFrame:
    """V1g: gold solution per order, ending in '#### N' (``rebalance=False`` for
    the static side of a stream join)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    o = spread(o) if rebalance else o
    g = F.floor("o_totalprice").cast("long") % 50 + 1
    return o.select(
        F.col("o_orderkey").alias("question_id"),
        F.concat(F.lit("How much is order "), _s("o_orderkey"), F.lit("?")).alias("question"),
        F.concat(F.lit("The items add up. #### "), _s(g)).alias("answer"))


def qa_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 train split: benchmark items as question / '#### id' answers."""
    b = read_table(spark, sf_dir, "benchmark")
    return spread(b.select(F.col("item_id").alias("qid"), F.col("text").alias("question"),
                           F.concat(F.lit("#### "), _s("item_id")).alias("answer")))


def qa_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 test split: documents as questions."""
    d = read_table(spark, sf_dir, "documents")
    return spread(d.select(F.col("doc_id").alias("qid"), F.col("text").alias("question"),
                           F.concat(F.lit("#### "), _s("doc_id")).alias("answer")))


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: word-problem fields from part.

    body = p_name ('' when key % 5 = 0), question = p_type, equation =
    'p_size*2' ('' when key % 7 = 0), answer = 2 * p_size; AQuA-style options,
    a rationale (holding 'Answer:' when key % 11 = 0) and a letter.
    """
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand")
    k = F.col("p_partkey")
    size = F.col("p_size")
    return spread(p.select(
        k.alias("pid"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.col("p_name")).alias("body"),
        F.concat(F.lit("  How many "), F.col("p_type"), F.lit(" parts?\n")).alias("question"),
        F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(_s(size), F.lit("*2"))).alias("equation"),
        _s(size * 2).alias("answer"),
        F.array(_s(size * 2), _s(size * 2 + 1), _s(size * 3), F.col("p_brand")).alias("options"),
        F.when(k % 11 == 0, F.concat(F.lit("Double it. Answer: "), _s(size * 2)))
         .otherwise(F.concat(F.lit("Double "), _s(size), F.lit(" to get "), _s(size * 2), F.lit(".")))
         .alias("rationale"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.lit("D")),
                     (k % 4 + 1).cast("int")).alias("correct")))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: documents as a pre-training corpus (text, lang, source, key)."""
    d = read_table(spark, sf_dir, "documents")
    return spread(d.select("doc_id", "text", "lang", "source"))


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: user turn + the next turn of the conversation (when it is the assistant's).

    source = 'data/PoT/' for conv_id % 3 = 0 else 'data/CoT/', then conv_id % 5.
    The next turn is found by an equi-join on (conv_id, turn + 1), so no
    conversation is gathered into one task.
    """
    c = read_table(spark, sf_dir, "conversations")
    user = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("instruction"))
    nxt = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    src = F.concat(F.when(F.col("conv_id") % 3 == 0, F.lit("data/PoT/")).otherwise(F.lit("data/CoT/")),
                   _s(F.col("conv_id") % 5))
    return user.join(nxt, ["conv_id", "turn"], "inner").select(
        "conv_id", "turn", "instruction", "output", src.alias("source"))


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: leaderboard rows as read from CSV (all strings) from part.

    Size: 'unknown' when key % 5 = 0, '' when key % 13 = 0, else p_size / 4
    written as text; score = (37 * key) % 100 with '.5' when key % 3 = 0, ''
    when key % 11 = 0; Published = yy-Mon of 2022-01 plus key % 40 months.
    """
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    k = F.col("p_partkey")
    size = (F.when(k % 5 == 0, F.lit("unknown")).when(k % 13 == 0, F.lit(""))
            .otherwise(F.concat(_s(F.floor(F.col("p_size") / 4)),
                                F.lit("."), _s((F.col("p_size") % 4) * 25))))
    score = F.when(k % 11 == 0, F.lit("")).otherwise(
        F.concat(_s((k * 37) % 100), F.when(k % 3 == 0, F.lit(".5")).otherwise(F.lit(""))))
    published = F.date_format(F.add_months(F.lit("2022-01-01").cast("date"), (k % 40).cast("int")), "yy-MMM")
    return spread(p.select(
        k.alias("row_key"),
        F.col("p_name").alias("Name"), F.col("p_brand").alias("Family"),
        published.alias("Published"), size.alias("Size (in Billion)"),
        score.alias("GSM8K Performance"), score.alias("MATH Performance")))


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: events as a training step log (see ``step_log_from``)."""
    raw = read_table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value")
    return step_log_from(spread(raw))


def step_log_from(events: DataFrame, *carry: str) -> DataFrame:
    """V7 over an events frame (batch or stream), with the columns of ``carry``: run = event_type, ordered
    by (ts, event_id); device batch 4; accumulation length(run) % 4 + 1."""
    return events.select(F.col("event_type").alias("run"), "event_id", "ts", "value",
                         F.lit(4).alias("batch"),
                         (F.length("event_type") % 4 + 1).cast("int").alias("accumulation"), *carry)
