"""Multiple-choice questions: benchmark access, option permutation, prompts, entity context, and the evaluation flow.

questions: (dataset, question_id, question, options array<struct<letter, text>>, answer). Predictions and encoders are
columns or functions that the caller supplies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolume.functions.text import option_lines, options_depend
from taxolume.sources.io import append_metrics
from taxolume.storage import Scratch, numbered

from .axioms import gate_axioms
from .metrics import accuracy
from .retrieve import best_entity, retrieve, select_entities, with_metadata

INSTRUCTION = "Answer the question below. Give the letter of the best choice only."
INSTRUCTION_WITH_CONTEXT = "Answer the question below. Use the context only where it supports a choice. Give the letter of the best choice only."


def questions_of(questions: DataFrame, datasets: list[str]) -> DataFrame:
    return questions.filter(F.col("dataset").isin(*datasets))


def benchmark_counts(questions: DataFrame) -> DataFrame:
    return questions.groupBy("dataset").agg(F.count("*").alias("n"))


def mentions_of(questions: DataFrame, *mentions: DataFrame) -> DataFrame:
    """questions with entities: the lists of all mention tables (dataset, question_id, entities) in turn; an empty one
    where there are none."""
    out, names = questions, []
    for i, m in enumerate(mentions):
        out = out.join(m.select("dataset", "question_id", F.col("entities").alias(f"_e{i}")), ["dataset", "question_id"], "left")
        names.append(F.coalesce(F.col(f"_e{i}"), F.array().cast(m.schema["entities"].dataType)))
    return out.withColumn("entities", F.concat(*names)).drop(*[f"_e{i}" for i in range(len(mentions))])


def permute(options: Column, answer: Column, seed: Column) -> Column:
    """struct<options, answer>: texts dealt anew to the letters, in an order fixed by the seed, and the answer's new
    letter, the first whose text is the same. Options that depend on each other stay."""
    order = F.array_sort(F.transform(options, lambda o: F.struct(F.md5(F.concat(seed.cast("string"), F.lit(":"), o["letter"])).alias("k"), o["letter"].alias("letter"), o["text"].alias("text"))))
    mixed = F.zip_with(options, order, lambda o, s: F.struct(o["letter"].alias("letter"), s["text"].alias("text")))
    right = F.element_at(F.filter(options, lambda o: o["letter"] == answer), 1)["text"]
    moved = F.element_at(F.filter(mixed, lambda o: o["text"].eqNullSafe(right)), 1)["letter"]
    stay = options_depend(options)
    return F.struct(F.when(stay, options).otherwise(mixed).alias("options"), F.when(stay, answer).otherwise(moved).alias("answer"))


def prompt(question: Column, options: Column, instruction: str = INSTRUCTION) -> Column:
    return F.concat(F.lit(instruction + "\n\nQuestion:\n"), question, F.lit("\n\nChoices:\n"), option_lines(options), F.lit("\n\nAnswer (letter only): "))


def prompt_with_axioms(question: Column, options: Column, axioms: Column, instruction: str = INSTRUCTION_WITH_CONTEXT) -> Column:
    """As prompt, with the axioms as context; without axioms the plain prompt."""
    full = F.concat(F.lit(instruction + "\n\nContext:\n"), F.array_join(axioms, "\n"), F.lit("\n\nQuestion:\n"), question, F.lit("\n\nChoices:\n"), option_lines(options), F.lit("\n\nAnswer (letter only): "))
    return F.when(F.coalesce(F.size(axioms), F.lit(0)) <= 0, prompt(question, options)).otherwise(full)


def open_prompt(question: Column, axioms: Column, instruction: str = INSTRUCTION_WITH_CONTEXT) -> Column:
    return F.concat(F.lit(instruction + "\n\nContext:\n"), F.coalesce(F.array_join(axioms, "\n"), F.lit("")), F.lit("\n\nQuestion:\n"), question, F.lit("\n\nAnswer: "))


def chat(content: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))


def run(questions: DataFrame, context: DataFrame | None, predict: Callable[[Column], Column], seed: str | None = None, least_overlap: int = 2) -> DataFrame:
    """(dataset, question_id, prompt, prediction, answer) of every question.

    context: (dataset, question_id, sentences) of the best entity's axioms; predict maps the prompt column to a letter.
    With a seed, options are permuted first.
    """
    q = questions
    if seed is not None:
        p = permute(F.col("options"), F.col("answer"), F.concat(F.lit(seed), F.lit("|"), "dataset", F.lit("|"), F.col("question_id").cast("string")))
        q = q.withColumn("_p", p).withColumns({"options": F.col("_p.options"), "answer": F.col("_p.answer")}).drop("_p")
    if context is None:
        made = prompt(F.col("question"), F.col("options"))
    else:
        q = q.join(context, ["dataset", "question_id"], "left")
        made = prompt_with_axioms(F.col("question"), F.col("options"), gate_axioms(F.col("sentences"), F.col("question"), least_overlap))
    out = q.withColumn("prompt", made)
    return out.select("dataset", "question_id", "prompt", predict(F.col("prompt")).alias("prediction"), "answer")


def run_datasets(questions: DataFrame, datasets: list[str], context: DataFrame | None, predict: Callable[[Column], Column], seed: str | None = None, least_overlap: int = 2) -> DataFrame:
    """run() over several datasets in one pass; one that has no question is an error."""
    own = questions_of(questions, datasets)
    there = {r["dataset"] for r in own.select("dataset").distinct().collect()}
    if missing := [d for d in datasets if d not in there]:
        raise ValueError(f"no questions of {', '.join(missing)}")
    return run(own, context, predict, seed, least_overlap)


def question_map(questions: DataFrame, dataset: str) -> DataFrame:
    """(i, question_id): a dataset's questions numbered from 0 in the order of their ids."""
    own = questions_of(questions, [dataset]).select("question_id").distinct()
    return numbered(own, [F.col("question_id")], "i", Scratch(questions.sparkSession, "questions")).select("i", "question_id")


def answer_context(questions: DataFrame, mentions: DataFrame, retriever, axioms: DataFrame, method: str, top: int = 10, append_k: int = 10, ascending: bool = True) -> DataFrame:
    """(question_id, id, iri, prompt, context, messages): what a language model is asked for each open question.

    mentions: (question_id, mention_id, q) with a vector each; retriever ranks them; the best `top` entities of all
    mentions, each once, bring their verbal and logical axioms (iri, sentences, logic). context is the first entity's
    sentence and its logical form; a question without entities has an empty one. Methods are hit and ont.
    """
    if method not in ("hit", "ont"):
        raise ValueError(f"no such method: {method}")
    ids = mentions.select(F.concat_ws("|", F.col("question_id").cast("string"), F.col("mention_id").cast("string")).alias("query_id"), "question_id", "mention_id", "q")
    found = retriever.top(ids.select("query_id", "q"), top)
    ranked = ids.select("query_id", "question_id", "mention_id").join(found, "query_id")
    ranked = ranked.withColumn("id", F.col("iri")) if "iri" in ranked.columns else ranked
    best = select_entities(ranked.select("question_id", "mention_id", "rank", "id", "score"), append_k, max(append_k, top), ascending, top)
    shown = best.join(axioms.select(F.col("iri").alias("id"), "label", "sentences", "logic"), "id", "left")
    line = lambda c: F.concat_ws(" ", "label", F.element_at(F.coalesce(c, F.array(F.lit(""))), 1))
    said = shown.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("place", line(F.when(F.size("sentences") > 0, F.col("sentences"))).alias("verbal"), line(F.when(F.size("logic") > 0, F.col("logic"))).alias("logic"), "id"))).alias("s")
    )
    out = questions.select("question_id", "question").join(said, "question_id", "left")
    verbal = F.transform("s", lambda x: x["verbal"])
    first = F.get(F.col("s"), F.lit(0))
    made = open_prompt(F.col("question"), verbal)
    return out.select("question_id", first["id"].alias("id"), made.alias("prompt"), F.coalesce(F.concat(first["verbal"], F.lit(" .. DL: "), first["logic"]), F.lit("")).alias("context"), chat(made).alias("messages"))


def harness(questions: DataFrame, mentions: DataFrame, retriever, axioms: DataFrame, predict: Callable[[Column], Column], datasets: list[str], folder: str | None = None, seed: str | None = None, least_overlap: int = 2, top: int = 10, ascending: bool = True) -> tuple[DataFrame, DataFrame]:
    """(results, accuracy) of a whole run: rank the mentions (dataset, question_id, mention_id, q), take each question's
    best entity, gate its sentences (iri, sentences) by the question, prompt, predict, score by dataset.

    Questions without mentions are prompted plainly. With a folder, results are written there as JSON lines by dataset
    and read back, and accuracies are appended as a table.
    """
    key = F.concat_ws("|", "dataset", F.col("question_id").cast("string"))
    ids = mentions.select(F.concat_ws("|", key, F.col("mention_id").cast("string")).alias("query_id"), key.alias("of"), "dataset", F.col("question_id").alias("qid"), "mention_id", "q")
    ranked = ids.drop("q").join(retriever.top(ids.select("query_id", "q"), top), "query_id")
    ranked = ranked.withColumn("id", F.col("iri")) if "iri" in ranked.columns else ranked
    best = best_entity(select_entities(ranked.select(F.col("of").alias("question_id"), "mention_id", "rank", "id", "score"), top, top, ascending), ascending)
    said = best.join(axioms.select(F.col("iri").alias("id"), "sentences"), "id").select(F.col("question_id").alias("of"), "sentences")
    context = ids.select("of", "dataset", F.col("qid").alias("question_id")).distinct().join(said, "of").drop("of")
    results = run_datasets(questions, datasets, context, predict, seed, least_overlap)
    if folder is not None:
        results.write.mode("overwrite").partitionBy("dataset").json(f"{folder}/results")
        results = questions.sparkSession.read.schema(results.schema).json(f"{folder}/results")
    scored = accuracy(results)
    if folder is not None:
        append_metrics(scored, f"{folder}/accuracy")
    return results, scored


#: The scores that each dense method takes by name, and what it falls back to.
METHODS = {"sbert": ({}, "cosine"), "hit": ({"entity-subsumption": "subsumption"}, "poincare"), "ont": ({"concept-subsumption": "subsumption"}, "poincare")}


def search_by_name(queries: DataFrame, table: DataFrame, entities: DataFrame, method: str, score_function: str | None = None, top: int = 10, weight: float | None = None, curvature: float = 1.0, lexical=None) -> DataFrame:
    """search() by the names of the service's methods: tf-idf, bm-25, sbert, hit, ont. A score function that a method
    does not have falls back to its distance; a weight of 0 or none is 0.35; another method is an error."""
    if method in ("tf-idf", "bm-25"):
        return search(queries, table, entities, method.replace("-", ""), None, top, lexical=lexical)
    if method not in METHODS:
        raise ValueError(f"no such method: {method}")
    named, plain = METHODS[method]
    return search(queries, table, entities, "dense", named.get(score_function or "", plain), top, weight or 0.35, curvature)


def search(queries: DataFrame, table: DataFrame, entities: DataFrame, method: str, score: str | None = None, top: int = 10, weight: float | None = None, curvature: float = 1.0, lexical=None) -> DataFrame:
    """(query_id, rank, iri, score, verbalisation) by a method: dense (with a score function), tfidf or bm25.

    Lexical methods take lexical: an index whose doc_id is the mapping_id; queries then have text instead of q. A
    weight that is not given is 0.35, and 0 means 0.
    """
    if not method or top is None or top <= 0:
        raise ValueError("a method and a positive top are needed")
    if method in ("tfidf", "bm25"):
        from . import lexical as L

        found = (L.tfidf_search if method == "tfidf" else L.bm25_search)(lexical, queries, top)
    elif method == "dense":
        if not score:
            raise ValueError("a dense search needs a score function")
        found = retrieve(queries, table, score, top, curvature, 0.35 if weight is None else weight, exclude_self=False)
    else:
        raise ValueError(f"no such method: {method}")
    return with_metadata(found, entities)
