"""QA-set generation (Q-01..Q-07) and sampling (P-15).

Question types fan out per document by exploding a 7-element literal array
(no join); the generation prompt is a ``concat`` of literals and columns; the
model is the same pluggable batch callable as answer generation (A-06); pairs
are pulled from responses with one ``regexp_extract_all`` per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PY_SPACE

# Question types and their instructions (must equal the source).
QUESTION_TYPES = {
    "confirmation": "Focus only on confirmation questions, i.e. questions that can be answered with a yes or no.",
    "factoid": "Focus only on factoid questions, that usually begin with a who, what, where, when, why, or how.",
    "list": "Focus only on list questions, i.e. questions that are answered with a list of items.",
    "causal": "Focus only on causal questions, i.e. questions that begin with why or how.",
    "hypothetical": "Focus only on hypothetical questions, i.e. questions that ask what if.",
    "complex": "Focus only on complex questions, i.e. questions that require multi-step reasoning and comparisons.",
    "default": "",
}

# Fixed value: the generation prompt. Its first line has no indent, so the others keep theirs;
# lines of blanks alone are emptied once the slots are filled.
PROMPT = """You are an oracle system for a Retrieval Augmented Generation System, that guesses questions that would be answered by a particular exerpt of text.
            Given the following exerpt of text, generate {n} question{s} that can be answered by the exerpt of text.
            ```
            {context}
            ```
            {type_prompt}
            Format the pairs as follows:
            ```
            {QUESTION i}: <question i> {ANSWER i}: <answer i>
            ```
            Do not add any additional newlines between the pairs. Directly continue with the answer after the question.
            Only add a newline between the pairs (after the answer) if you want to add more pairs.
            Do not deviate from this format, since it will be used to extract the questions with the following regex: `{QUESTION \\d+}: .+ {ANSWER \\d+}: .+`
            """

# Fixed value, Q-05 pattern: back-reference on the pair number, lookahead to the next pair or the end.
# (?d): only '\n' ends a line, as in Python's re.
PAIR_PATTERN = (r"(?d)\{QUESTION (\d+)\}:" + PY_SPACE + r"*(.*?)" + PY_SPACE + r"*\{ANSWER \1\}:" + PY_SPACE
                + r"*(.*?)" + PY_SPACE + r"*(?=\{QUESTION \d+\}|$)")


def type_prompt(t: Column) -> Column:
    m = F.create_map(*[x for k, v in QUESTION_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[t], F.lit(""))


def all_types(df: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Q-01: one row per (document, question type)."""
    names = types or list(QUESTION_TYPES)
    return df.withColumn("type", F.explode(F.array(*[F.lit(n) for n in names])))


def random_type(df: DataFrame, id_col: str, seed: int = 0, types: list[str] | None = None) -> DataFrame:
    """Q-02: one seeded type per document: ``types[pmod(xxhash64(id, seed), n)]`` (NumPy's stream is not reproducible on a cluster)."""
    names = types or list(QUESTION_TYPES)
    arr = F.array(*[F.lit(n) for n in names])
    return df.withColumn("type", F.get(arr, F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(len(names))).cast("int")))


def oracle_context(text_meta: Column, page_content: Column) -> Column:
    """Q-03: enriched documents carry the raw text as metadata; use it when present."""
    return F.coalesce(text_meta, page_content)


def oracle_prompt(context: Column, qtype: Column, n: int = 1) -> Column:
    """Q-04: the generation prompt; plural 's' when n > 1."""
    text = PROMPT.replace("{n}", str(n)).replace("{s}", "s" if n > 1 else "")
    before, rest = text.split("{context}")
    between, after = rest.split("{type_prompt}")
    filled = F.concat(F.lit(before), F.coalesce(context, F.lit("")), F.lit(between), type_prompt(qtype), F.lit(after))
    return F.regexp_replace(filled, r"(?md)^[ \t]+$", "")


def extract_qa_pairs(response: Column) -> Column:
    """Q-05: array<struct<question, answer>>; pairs with a blank side are dropped."""
    qs = F.regexp_extract_all(response, F.lit(PAIR_PATTERN), 2)
    ans = F.regexp_extract_all(response, F.lit(PAIR_PATTERN), 3)
    strip = f"^{PY_SPACE}+|{PY_SPACE}+$"
    pairs = F.zip_with(qs, ans, lambda q, a: F.struct(F.regexp_replace(q, strip, "").alias("question"),
                                                     F.regexp_replace(a, strip, "").alias("answer")))
    return F.filter(pairs, lambda p: (p["question"] != "") & (p["answer"] != ""))


def flatten_pairs(df: DataFrame, source_col: str, type_col: str, pairs_col: str) -> DataFrame:
    """Q-06: one row per pair: (source, type, question, answer)."""
    return df.select(F.col(source_col).alias("source"), F.col(type_col).alias("type"),
                     F.explode(pairs_col).alias("p")).select("source", "type", "p.question", "p.answer")


def sample_n(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """P-15: n rows without replacement, deterministic by ``xxhash64(id, seed)`` (a top-n, not a shuffle)."""
    return df.withColumn("_h", F.xxhash64(F.col(id_col), F.lit(seed))).orderBy("_h", id_col).limit(n).drop("_h")


def generate_oracle_dataset(docs: DataFrame, id_col: str, text_col: str, strategy: str = "all", n: int = 1,
                            seed: int = 0, model=None, sample: int | None = None) -> DataFrame:
    """Q-07: (sample) -> types -> prompt -> generate -> extract -> flatten: (source, type, question, answer)."""
    from .context import generate
    from .prompts import message

    d = sample_n(docs, sample, seed, id_col) if sample else docs
    d = all_types(d) if strategy == "all" else random_type(d, id_col, seed)
    d = d.withColumn("prompt", F.array(message("human", oracle_prompt(F.col(text_col), F.col("type"), n))))
    d = generate(d, "prompt", "response", model)
    d = d.withColumn("pairs", extract_qa_pairs(F.col("response")))
    return flatten_pairs(d, id_col, "type", "pairs")
