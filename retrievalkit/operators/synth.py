"""Query synthesis data work (Q1-Q5): the tables before and after the model
call. The model call itself is outside (a ``prompts`` table goes out, a
``responses`` table comes back; Q6 stores it).
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retrievalkit.operators.sampling import dense_index
from retrievalkit.tables import RagTables

# ---- fixed values (must equal the reference for the same prompts / parsing) ----------
QUESTION_KEY = "问题"
ANSWER_KEY = "答案"
DEFAULT_QA_TEMPLATE = """\
上下文信息如下。
---------------------
{context_str}
---------------------

你是一位教师/教授。您的任务是为即将到来的测验/考试设置 {num_questions_per_chunk} 个问答对。

- 这些问答对应在整个文档中均匀分布。
- 将问题和答案限制在所提供的上下文信息中。
- 每个问题只能包含一个提问点。
- 仅根据上下文信息，而非先验知识。
- 请以JSON格式输出问答对，"问题" 和 "答案" 为字段，必须严格遵守 JSON 格式，格式如下：

```json
[
  {{"问题": "问题1", "答案": "答案1"}},
  {{"问题": "问题2", "答案": "答案2"}},
  ...
]
```
"""
DEFAULT_N_QUESTIONS = 10
MIN_QA_LEN = 5
# ---- end of fixed values -----------------------------------------------------------------

QA_SCHEMA = T.ArrayType(T.StructType([
    T.StructField(QUESTION_KEY, T.StringType()),
    T.StructField(ANSWER_KEY, T.StringType()),
]))


def template_parts(template: str):
    """Split a ``str.format`` template once, on the driver: literal text
    (``{{``/``}}`` already unescaped) and field names, in order."""
    parts = []
    for literal, field, spec, conv in string.Formatter().parse(template):
        if literal:
            parts.append(("lit", literal))
        if field is not None:
            if spec or conv:
                raise ValueError("format specs are not supported in prompt templates")
            parts.append(("field", field))
    return parts


def render_prompts(corpus: DataFrame, template: str = DEFAULT_QA_TEMPLATE,
                   n_questions: int = DEFAULT_N_QUESTIONS, *, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Q1: ``(doc_id, prompt_key, prompt)``; one pass of ``concat`` so a
    document containing ``{num_questions_per_chunk}`` is not substituted."""
    values = {"context_str": F.col(text_col), "num_questions_per_chunk": F.lit(str(n_questions))}
    cols = []
    for kind, v in template_parts(template):
        if kind == "lit":
            cols.append(F.lit(v))
        elif v in values:
            cols.append(values[v])
        else:
            raise KeyError(v)
    prompt = F.concat(*cols) if cols else F.lit("")
    return corpus.select(F.col(id_col).cast("string").alias("doc_id"), prompt.alias("prompt")) \
        .withColumn("prompt_key", F.sha2("prompt", 256)) \
        .select("doc_id", "prompt_key", "prompt")


def distinct_prompts(prompts: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Q2: prompts still to send: one per distinct prompt (smallest doc_id
    keeps it), minus those whose ``prompt_key`` already has a response."""
    todo = prompts.groupBy("prompt_key").agg(
        F.min(F.struct("doc_id", "prompt")).alias("m")).select(
        "prompt_key", "m.doc_id", "m.prompt")
    if done is not None:
        todo = todo.join(done.select("prompt_key").distinct(), "prompt_key", "left_anti")
    return todo.select("doc_id", "prompt_key", "prompt")


def parse_qa(responses: DataFrame, *, id_col: str = "corpus_id",
             text_col: str = "response") -> DataFrame:
    """Q3: ``(corpus_id, questions, answer, is_malformed)``.

    A markdown JSON fence is stripped when present; the payload must be a
    JSON **array** of objects; pairs with an empty question or answer are
    dropped. A broken or wrongly shaped payload gives empty lists and
    ``is_malformed`` (the document is skipped, the rest goes on).
    """
    raw = F.col(text_col)
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    payload = F.trim(F.when(fenced != "", fenced).otherwise(F.coalesce(raw, F.lit(""))))
    parsed = F.when(payload.startswith("["), F.from_json(payload, QA_SCHEMA, {"mode": "PERMISSIVE"}))
    ok = F.filter(F.col("arr"), lambda x: x.isNotNull()
                  & (F.coalesce(x[QUESTION_KEY], F.lit("")) != "")
                  & (F.coalesce(x[ANSWER_KEY], F.lit("")) != ""))
    return (responses.select(F.col(id_col).cast("string").alias("corpus_id"), parsed.alias("arr"))
            .select("corpus_id", ok.alias("ok"), F.col("arr").isNull().alias("is_malformed"))
            .select("corpus_id",
                    F.coalesce(F.transform("ok", lambda x: x[QUESTION_KEY]),
                               F.array().cast("array<string>")).alias("questions"),
                    F.coalesce(F.transform("ok", lambda x: x[ANSWER_KEY]),
                               F.array().cast("array<string>")).alias("answer"),
                    "is_malformed"))


def explode_qa(parsed: DataFrame, min_len: int = MIN_QA_LEN) -> DataFrame:
    """Q4: ``(query_id, corpus_id, question, answer)``; the id
    ``q-{corpus_id}-{i}`` numbers pairs after the non-empty filter and before
    the length filter (so ids can have gaps); both texts must be longer than
    ``min_len`` code points."""
    pairs = parsed.select("corpus_id", F.posexplode(F.arrays_zip("questions", "answer"))
                          .alias("i", "p"))
    return (pairs.select(
        F.concat(F.lit("q-"), F.col("corpus_id"), F.lit("-"), F.col("i").cast("string"))
        .alias("query_id"), "corpus_id",
        F.col("p.questions").alias("question"), F.col("p.answer").alias("answer"))
        .where((F.length("question") > min_len) & (F.length("answer") > min_len)))


def _next_ord(df: DataFrame) -> int:
    """One scalar (max ord + 1) from a global aggregate."""
    v = df.agg(F.max("ord").alias("m")).first()["m"]
    return 0 if v is None else int(v) + 1


def append_synthetic(tables: RagTables, qa: DataFrame, split: str = "train") -> RagTables:
    """Q5: upsert synthetic queries, answers and relevance (replaced by exactly
    the source document) by id, and append the new ids to ``split`` (created
    if absent; ids already in it are not added twice). New queries and list
    entries are numbered after the existing ones, in (corpus_id, i) order."""
    new = qa.select("query_id", "corpus_id", "question", "answer",
                    F.element_at(F.split("query_id", "-"), -1).cast("long").alias("_i"))
    ids = new.select("query_id")
    base_q = _next_ord(tables.queries)
    fresh_q = new.join(tables.queries.select("query_id"), "query_id", "left_anti")
    numbered = dense_index(fresh_q.select("query_id", "question", "corpus_id", "_i"),
                           [F.col("corpus_id"), F.col("_i")], out="n")
    appended_q = numbered.select(
        "query_id", F.col("question").alias("text"), (F.lit(base_q) + F.col("n")).alias("ord"))
    # upsert: an existing id keeps its position, takes the new text
    upd = tables.queries.join(new.select("query_id", F.col("question").alias("_t")),
                              "query_id", "left").select(
        "query_id", F.coalesce("_t", "text").alias("text"), "ord")
    queries = upd.unionByName(appended_q)
    qrels = (tables.qrels.join(ids, "query_id", "left_anti")
             .unionByName(tables.qrels.where("relevance <> 1").join(ids, "query_id", "left_semi"))
             .unionByName(new.select("query_id", F.col("corpus_id").alias("doc_id"),
                                     F.lit(1).alias("relevance"))))
    answers = (tables.answers.join(ids, "query_id", "left_anti")
               .unionByName(new.select("query_id", "answer")))
    in_split = tables.splits.where(F.col("split") == split)
    base_s = _next_ord(in_split)
    add = new.join(in_split.select("query_id"), "query_id", "left_anti")
    add_n = dense_index(add.select("query_id", "corpus_id", "_i"),
                        [F.col("corpus_id"), F.col("_i")], out="n")
    splits = tables.splits.unionByName(add_n.select(
        "query_id", F.lit(split).alias("split"), (F.lit(base_s) + F.col("n")).alias("ord")))
    return tables.with_(queries=queries, qrels=qrels, answers=answers, splits=splits)
