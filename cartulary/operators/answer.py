"""Questions to a graph: the prompt, the answer with its citations, and what is said where there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions.json_repair import repair
from cartulary.operators.extract import ANSWER, PROMPTS, prompt
from cartulary.operators.search import citation_anchors

NO_ANSWER = "The model gave no answer that can be read."


def question_prompts(questions: DataFrame, context: DataFrame) -> DataFrame:
    """questions (question_id, question) with prompt. context: the one row of search.question_context()."""
    text = context.limit(1).select("context")
    return questions.join(F.broadcast(text)).withColumn("prompt", prompt(PROMPTS["answer"], context=F.col("context"), question=F.col("question"))).drop("context")


def messages(responses: DataFrame) -> DataFrame:
    """question_id, place, role, content, citations: each question (place 0, user), then its answer (assistant), or why there is none (error).

    responses: question_id, question, response (null for a call that failed).
    """
    read = responses.withColumn("a", F.from_json(repair("response"), ANSWER))
    own = read.select("question_id", F.lit(0).alias("place"), F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(None).cast(read.schema["a"].dataType["citations"].dataType).alias("citations"))
    said = F.col("a.answer").isNotNull()
    reply = read.select("question_id", F.lit(1).alias("place"), F.when(said, "assistant").otherwise("error").alias("role"), F.when(said, F.col("a.answer")).otherwise(F.lit(NO_ANSWER)).alias("content"), F.when(said, F.col("a.citations")).alias("citations"))
    return own.unionByName(reply)


def cited(replies: DataFrame, anchors: DataFrame) -> DataFrame:
    """question_id, ord, node_id, matched: the best anchor of each citation with a page."""
    each = replies.filter("role = 'assistant'").select("question_id", F.posexplode("citations").alias("ord", "c"))
    keyed = each.select(F.struct("question_id", "ord").alias("citation_id"), F.col("c.text").alias("text"), F.col("c.pageIndex").alias("page"))
    found = citation_anchors(keyed, anchors)
    return found.select("citation_id.question_id", F.col("citation_id.ord").alias("ord"), "node_id", "matched")
