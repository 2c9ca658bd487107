"""Conversations, feedback, tenants and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import is_follow_up, token_estimate


def last_turns(turns: DataFrame, limit: int) -> DataFrame:
    """The last turns of each session (conv_id, turn, ...); a limit of 0 means all."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return turns.withColumn("__p", place).where(F.col("__p") <= limit).drop("__p") if limit > 0 else turns


def exchanges(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each user turn and the assistant's next one."""
    w = W.partitionBy("conv_id").orderBy("turn")
    nxt = turns.where("role in ('user', 'assistant')").withColumn("answer", F.when(F.lead("role").over(w) == "assistant", F.lead("text").over(w)))
    return nxt.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def standalone_queries(turns: DataFrame, most: int = 6) -> DataFrame:
    """(conv_id, turn, query, is_follow_up): each question with what it needs of the exchanges before it. A follow-up gets the last most exchanges, another question the last one in a line."""
    e = exchanges(turns)
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-most, -1)
    rendered = F.array_join(F.transform(F.col("h"), lambda x: F.concat(F.lit("Utilisateur: "), x["q"], F.lit("\nAssistant: "), F.substring(x["a"], 1, 500))), "\n")
    e = e.withColumn("h", F.collect_list(F.struct(F.col("question").alias("q"), F.coalesce("answer", F.lit("")).alias("a"))).over(before))
    last = F.element_at(F.col("h"), -1)
    follow = is_follow_up(F.col("question"))
    context = F.concat(F.lit("Contexte conversationnel récent: utilisateur="), last["q"], F.lit("; assistant="), F.substring(last["a"], 1, 300), F.lit("\nQuestion: "), F.col("question"))
    query = F.when(F.size("h") == 0, F.col("question")).when(follow, F.concat(rendered, F.lit("\nQuestion de suivi: "), F.col("question"))).otherwise(context)
    return e.select("conv_id", "turn", query.alias("query"), follow.alias("is_follow_up"))


def rating(raw: Column) -> Column:
    r = F.lower(F.trim(raw))
    return F.when(r.isin("positive", "pos", "good", "up", "thumbs_up", "1", "true", "ok"), "positive").when(r.isin("negative", "neg", "bad", "down", "thumbs_down", "0", "-1", "false", "ko"), "negative").otherwise("neutral")


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """(rating, n, share), one row per rating; the total's one row is the only thing broadcast."""
    counts = feedback.groupBy("rating").agg(F.count("*").alias("n"))
    total = feedback.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("rating", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def missing_sources(feedback: DataFrame, most: int = 10) -> DataFrame:
    """The most frequent sources that corrections name and retrieval did not bring: (source_id, n). Feedback: correct_source_ids, retrieved_source_ids."""
    gone = feedback.select(F.explode(F.array_except("correct_source_ids", "retrieved_source_ids")).alias("source_id"))
    return gone.groupBy("source_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_id").limit(most)


def to_eval_set(feedback: DataFrame, only_negative: bool = True) -> DataFrame:
    """Feedback as evaluation examples: question, expected_answer, expected_doc_ids, metadata."""
    rows = feedback.where("rating = 'negative'") if only_negative else feedback
    return rows.select(F.col("query").alias("question"), F.coalesce("correct_answer", "answer").alias("expected_answer"), F.col("correct_source_ids").alias("expected_doc_ids"), F.struct("feedback_id", "rating").alias("metadata"))


def select_feedback(feedback: DataFrame, **equals) -> DataFrame:
    """Rows whose attributes equal the given ones; None asks for nothing."""
    for name, value in equals.items():
        feedback = feedback if value is None else feedback.where(F.col(name) == value)
    return feedback


def tenant_statistics(docs: DataFrame) -> DataFrame:
    """(tenant_id, documents, collections) per tenant."""
    return docs.groupBy("tenant_id").agg(F.count("*").alias("documents"), F.array_sort(F.collect_set("collection_id")).alias("collections"))


def usage(calls: DataFrame, prompt_price: float, answer_price: float) -> DataFrame:
    """calls (prompt, answer) with estimated tokens and cost; prices are per thousand tokens."""
    p, a = token_estimate(F.col("prompt")), token_estimate(F.col("answer"))
    return calls.withColumn("prompt_tokens", p).withColumn("answer_tokens", a).withColumn("cost", F.round(p / 1000 * prompt_price + a / 1000 * answer_price, 8))
