"""Queries over multiple-choice questions, mentions and entity selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxolume.functions import text as T
from taxolume.operators import qa as Q
from taxolume.operators import retrieve as R

from .views import ASKED, D2, K, asked, points, r6, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Each part as a question after its brand, with four options; one in ten has an option that depends on the others.
_MCQA = """mcqa AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'parts' ELSE 'brands' END AS dataset, p_partkey AS question_id, 'Which brand has ' || p_name || '?' AS question,
  [{'letter': 'A', 'text': p_brand}, {'letter': 'B', 'text': p_type}, {'letter': 'C', 'text': 'size ' || p_size}, {'letter': 'D', 'text': CASE WHEN p_partkey % 10 = 0 THEN 'None of the above' ELSE p_name END}] AS options, 'A' AS answer FROM part)"""


def questions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    option = lambda x, c: F.struct(F.lit(x).alias("letter"), c.alias("text"))
    last = F.when(F.col("p_partkey") % 10 == 0, "None of the above").otherwise(F.col("p_name"))
    options = F.array(option("A", F.col("p_brand")), option("B", F.col("p_type")), option("C", F.concat(F.lit("size "), F.col("p_size").cast("string"))), option("D", last))
    return p.select(F.when(F.col("p_partkey") % 3 == 0, "parts").otherwise("brands").alias("dataset"), F.col("p_partkey").alias("question_id"), F.concat(F.lit("Which brand has "), "p_name", F.lit("?")).alias("question"), options.alias("options"), F.lit("A").alias("answer"))


_LINES = "array_to_string(list_transform(options, lambda o: o.letter || '. ' || o.text), chr(10))"
_DEP = "len(list_filter(options, lambda o: regexp_matches(o.text, '(all of the above|none of the above|neither|both|option\\s+[A-F]|answers?\\s+[A-F])', 'i'))) > 0"


@query(f"WITH {_MCQA} SELECT question_id, array_to_string(list_transform(options, lambda o: o.letter), ',') AS letters, {_LINES} AS lines, {_DEP} AS depends FROM mcqa")
def option_lists(spark, sf_dir):
    o = F.col("options")
    return questions(spark, sf_dir).select("question_id", T.option_letters(o).alias("letters"), T.option_lines(o).alias("lines"), T.options_depend(o).alias("depends"))


_PERM = f"""{_MCQA}, o AS (SELECT question_id, answer, options, {_DEP} AS stay, unnest(options) AS o FROM mcqa),
r AS (SELECT question_id, stay, o.letter AS letter, o.text AS text, row_number() OVER (PARTITION BY question_id ORDER BY o.letter) AS i, row_number() OVER (PARTITION BY question_id ORDER BY md5('1|' || question_id || ':' || o.letter), o.letter) AS j FROM o),
n AS (SELECT a.question_id, a.letter, CASE WHEN a.stay THEN a.text ELSE b.text END AS text FROM r a JOIN r b ON a.question_id = b.question_id AND a.i = b.j)"""


@query(f"WITH {_PERM}, w AS (SELECT n.question_id, min(n.letter) AS answer FROM n JOIN r ON r.question_id = n.question_id AND r.letter = 'A' AND r.text = n.text GROUP BY n.question_id) SELECT n.question_id, array_to_string(list(n.letter || '. ' || n.text ORDER BY n.letter), chr(10)) AS lines, any_value(w.answer) AS answer FROM n JOIN w ON n.question_id = w.question_id GROUP BY n.question_id")
def option_permute(spark, sf_dir):
    p = Q.permute(F.col("options"), F.col("answer"), F.concat(F.lit("1|"), F.col("question_id").cast("string")))
    return questions(spark, sf_dir).withColumn("p", p).select("question_id", T.option_lines(F.col("p.options")).alias("lines"), F.col("p.answer").alias("answer"))


def _prompt_sql(context: str | None) -> str:
    first = Q.INSTRUCTION if context is None else Q.INSTRUCTION_WITH_CONTEXT
    middle = "" if context is None else f" || chr(10) || chr(10) || 'Context:' || chr(10) || {context}"
    return f"'{first}'{middle} || chr(10) || chr(10) || 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Choices:' || chr(10) || {_LINES} || chr(10) || chr(10) || 'Answer (letter only): '"


@query(f"WITH {_MCQA} SELECT question_id, {_prompt_sql(None)} AS plain, CASE WHEN question_id % 5 = 0 THEN {_prompt_sql(None)} ELSE {_prompt_sql(chr(39) + 'fact ' + chr(39) + ' || question_id')} END AS informed, 'user' AS role FROM mcqa")
def prompt_build(spark, sf_dir):
    q = questions(spark, sf_dir)
    facts = F.when(F.col("question_id") % 5 != 0, F.array(F.concat(F.lit("fact "), F.col("question_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    informed = Q.prompt_with_axioms(F.col("question"), F.col("options"), facts)
    return q.select("question_id", Q.prompt(F.col("question"), F.col("options")).alias("plain"), informed.alias("informed"), F.element_at(Q.chat(informed), 1)["role"].alias("role"))


@query(f"WITH {_MCQA}, d AS (SELECT question_id, ('0x' || substr(md5(dataset || '|' || question_id), 1, 8))::BIGINT AS seed FROM mcqa) SELECT question_id, seed FROM d")
def question_seeds(spark, sf_dir):
    return questions(spark, sf_dir).select("question_id", T.question_seed(F.col("dataset"), F.col("question_id")).alias("seed"))


#: A stand-in for a model: right for two parts in three, else a letter or none by the part's number.
_GUESS = "CASE WHEN question_id % 3 <> 1 THEN 'The answer is A.' WHEN question_id % 2 = 0 THEN 'B, I think' ELSE 'no idea' END"


def _answers(spark, sf_dir):
    i = F.col("question_id")
    said = F.when(i % 3 != 1, "The answer is A.").when(i % 2 == 0, "B, I think").otherwise("no idea")
    letters = F.transform("options", lambda o: o["letter"])
    return questions(spark, sf_dir).select("dataset", "question_id", T.answer_letter(said, letters).alias("prediction"), "answer")


_ANSWERS = f"{_MCQA}, a AS (SELECT dataset, question_id, answer, CASE WHEN list_contains(list_transform(options, lambda o: o.letter), regexp_extract({_GUESS}, '\\b([A-Z])\\b', 1)) THEN regexp_extract({_GUESS}, '\\b([A-Z])\\b', 1) END AS prediction FROM mcqa)"


@query(f"WITH {_ANSWERS} SELECT dataset, sum(coalesce((prediction = answer)::INTEGER, 0))::BIGINT AS correct, count(*) AS total, round(avg(coalesce((prediction = answer)::INTEGER, 0)) * 100, 2) AS accuracy FROM a GROUP BY dataset")
def qa_accuracy(spark, sf_dir):
    from taxolume.operators.metrics import accuracy

    return accuracy(_answers(spark, sf_dir))


@query(f"WITH {_ANSWERS} SELECT dataset, prediction, count(*) AS n FROM a WHERE prediction IS DISTINCT FROM answer GROUP BY ALL")
def wrong_answer_counts(spark, sf_dir):
    from taxolume.operators.metrics import wrong_counts

    return wrong_counts(_answers(spark, sf_dir), "prediction")


@query(f"WITH {_MCQA} SELECT dataset, count(*) AS n FROM mcqa GROUP BY dataset")
def benchmark_counts(spark, sf_dir):
    return Q.benchmark_counts(Q.questions_of(questions(spark, sf_dir), ["parts", "brands"]))


def hashed_letter(prompt):
    """A stand-in for a model: a letter that depends on the whole prompt."""
    return F.substring(F.lit("ABCD"), F.conv(F.substring(F.md5(prompt), 1, 8), 16, 10).cast("long") % 4 + 1, F.lit(1))


LETTER = "substr('ABCD', (('0x' || substr(md5({0}), 1, 8))::BIGINT % 4 + 1)::BIGINT, 1)"


def prompt_sql(question: str, lines: str, context: str | None = None) -> str:
    """The SQL of a prompt; context is an expression, null for none."""
    tail = f"chr(10) || chr(10) || 'Question:' || chr(10) || {question} || chr(10) || chr(10) || 'Choices:' || chr(10) || {lines} || chr(10) || chr(10) || 'Answer (letter only): '"
    plain = f"'{Q.INSTRUCTION}' || {tail}"
    if context is None:
        return plain
    return f"CASE WHEN {context} IS NULL THEN {plain} ELSE '{Q.INSTRUCTION_WITH_CONTEXT}' || chr(10) || chr(10) || 'Context:' || chr(10) || {context} || {tail} END"


@query(f"""WITH {_PERM}, w AS (SELECT n.question_id, min(n.letter) AS answer FROM n JOIN r ON r.question_id = n.question_id AND r.letter = 'A' AND r.text = n.text GROUP BY n.question_id),
l AS (SELECT question_id, array_to_string(list(letter || '. ' || text ORDER BY letter), chr(10)) AS lines FROM n GROUP BY question_id),
p AS (SELECT dataset, question_id, {prompt_sql('question', 'lines', 'question')} AS prompt, w.answer FROM mcqa JOIN w USING (question_id) JOIN l USING (question_id))
SELECT dataset, question_id, prompt, {LETTER.format('prompt')} AS prediction, answer FROM p""")
def harness_run(spark, sf_dir):
    """The evaluation flow with permuted options, a fact as context, and a predictor that depends on the whole prompt."""
    q = questions(spark, sf_dir)
    facts = q.select("dataset", "question_id", F.array("question", F.lit("a thing apart")).alias("sentences"))
    # The seed column of the flow is seed|dataset|id; here the dataset is left out of the seed as in option_permute.
    p = Q.permute(F.col("options"), F.col("answer"), F.concat(F.lit("1|"), F.col("question_id").cast("string")))
    mixed = q.withColumn("_p", p).withColumns({"options": F.col("_p.options"), "answer": F.col("_p.answer")}).drop("_p")
    return Q.run(mixed, facts, hashed_letter).select("dataset", "question_id", "prompt", "prediction", "answer")


_MENTION = f"m AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[{T.SPACES}]+'), lambda x: x <> '') AS t FROM conversations)"


def _mentions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(T.tokenise(F.col("text"))).alias("mention"))


@query(f"WITH {_MENTION}, e AS (SELECT conv_id, turn, unnest(t) AS mention FROM m), n AS (SELECT *, trim(regexp_replace(mention, '[^a-z0-9]+', ' ', 'g')) AS x FROM e) SELECT conv_id, turn, mention FROM n WHERE x <> '' AND x NOT IN ('the', 'and', 'of', 'in', 'is', 'user', 'that')")
def stop_mentions(spark, sf_dir):
    vocabulary = spark.createDataFrame([(w,) for w in ("the", "and", "of", "in", "is", "user", "that")], "word string")
    return R.drop_stop_mentions(_mentions(spark, sf_dir), vocabulary)


@query(f"WITH {_MENTION}, g AS (SELECT conv_id, flatten(list(t ORDER BY turn)) AS e FROM m GROUP BY conv_id), q AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) SELECT q.conv_id AS question_id, list_concat(coalesce(a.e, []), CASE WHEN q.conv_id % 2 = 0 THEN coalesce(a.e, []) ELSE [] END) AS entities FROM q LEFT JOIN g a ON a.conv_id = q.conv_id")
def merge_mentions(spark, sf_dir):
    """Both lists of a conversation; every second one has no second list."""
    words = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", T.tokenise(F.col("text")).alias("t")))), lambda x: x["t"])).alias("entities"))
    lists = words.select(F.lit("c").alias("dataset"), F.col("conv_id").alias("question_id"), "entities")
    q = lists.select("dataset", "question_id")
    return Q.mentions_of(q, lists, lists.filter("question_id % 2 = 0")).select("question_id", "entities")


_SELECT = ASKED + f", s AS (SELECT query_id, id, sqrt({D2.format('q', 'vec')}) AS score FROM asked, points WHERE id <> query_id), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM s), cand AS (SELECT query_id // 300 AS question_id, query_id AS mention_id, id, score FROM rk WHERE rank <= 5)"


def _ranked(spark, sf_dir):
    pts = points(spark, sf_dir)
    found = R.retrieve(asked(pts).select("query_id", "q"), pts.select("id", "vec"), "l2", 20, K)
    return found.select(F.floor(F.col("query_id") / 300).cast("long").alias("question_id"), F.col("query_id").alias("mention_id"), "rank", "id", "score")


@query(f"WITH {_SELECT} SELECT question_id, mention_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY score, id, mention_id)::INTEGER AS place FROM cand")
def entity_selector(spark, sf_dir):
    return R.select_entities(_ranked(spark, sf_dir), 5, 20, ascending=True).select("question_id", "mention_id", "id", r6(F.col("score")).alias("score"), "place")


@query(f"WITH {_SELECT}, f AS (SELECT *, row_number() OVER (PARTITION BY question_id, id ORDER BY score, id, mention_id) AS n FROM cand), p AS (SELECT question_id, mention_id, id, score, row_number() OVER (PARTITION BY question_id ORDER BY score, id, mention_id)::INTEGER AS place FROM f WHERE n = 1) SELECT question_id, mention_id, id, round(score, 6) AS score, place FROM p WHERE place <= 3")
def top_candidates(spark, sf_dir):
    return R.select_entities(_ranked(spark, sf_dir), 5, 20, ascending=True, top=3).select("question_id", "mention_id", "id", r6(F.col("score")).alias("score"), "place")


@query(f"WITH {_SELECT} SELECT question_id, min_by(id, (score, id)) AS id, round(min(score), 6) AS score FROM cand GROUP BY question_id")
def best_entity(spark, sf_dir):
    return R.best_entity(R.select_entities(_ranked(spark, sf_dir), 5, 20, ascending=True), ascending=True).select("question_id", "id", r6(F.col("score")).alias("score"))


@query(ORACLES["best_entity"].replace("min_by(id, (score, id)) AS id", "CASE WHEN min(score) >= 4.0 THEN min_by(id, (score, id)) END AS id"))
def gated_entity(spark, sf_dir):
    return R.best_entity(R.select_entities(_ranked(spark, sf_dir), 5, 20, ascending=True), ascending=True, gate=4.0).select("question_id", "id", r6(F.col("score")).alias("score"))


@query(f"WITH {ASKED}, s AS (SELECT query_id, id, list_inner_product(q, vec) / (sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(vec, vec))) AS score FROM asked, points), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INTEGER AS rank FROM s) SELECT query_id, rank, 'iri/' || id AS iri, round(score, 6) AS score, 'point ' || id AS verbalisation FROM r WHERE rank <= 5")
def search(spark, sf_dir):
    pts = points(spark, sf_dir)
    meta = pts.select(F.col("id").alias("mapping_id"), F.concat(F.lit("iri/"), F.col("id").cast("string")).alias("iri"), F.concat(F.lit("point "), F.col("id").cast("string")).alias("verbalisation"))
    return Q.search(asked(pts).select("query_id", "q"), pts.select("id", "vec"), meta, "dense", "cosine", 5, curvature=K).withColumn("score", r6(F.col("score")))
