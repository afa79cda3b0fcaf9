"""Quality rules as a short-circuit cascade ordered by rejections per unit of cost.

Every rule is a JVM expression that is true for a text it rejects. A sample of the documents gives each
rule's cost (run time) and selectivity (share rejected); the rules then run in one CASE expression, the one
with most rejections per cost first, so a rejected document pays for no later rule. The order changes the
cost only: a document is kept when no rule rejects it.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import quoted

SYMBOLS = "#$%&*|!<>{}~^\\"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"
DIGITS = "0123456789"
#: Rows that the cost and selectivity estimates are drawn from, about, spread over the whole table.
SAMPLE_ROWS, SAMPLE_TASKS = 6000, 4
MAX_SYMBOLS, MAX_CAPITALS, MAX_DIGITS, MAX_REPEATED_WORDS, MAX_REPEATED_LINES, MAX_WORD_CHARS = 0.03, 0.3, 0.6, 0.1, 0.5, 25


def _share(text: Column, chars: str) -> Column:
    held = "".join("\\" + c if c in "\\^[]-&" else c for c in chars)
    return F.length(F.regexp_replace(text, f"[^{held}]+", "")) / F.greatest(F.length(text), F.lit(1))


def rules(text: Column) -> dict[str, Column]:
    """Rule name -> true where the text is rejected. A null text is rejected as blank."""
    words = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")
    gaps = F.length(text) * 2 - F.length(F.replace(text, F.lit(" "), F.lit(""))) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    lines = F.split(text, "\n")
    again = F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.size(words)), lambda w, after: w == after), lambda same: same))
    return {
        "blank": F.coalesce(F.length(F.trim(text)) == 0, F.lit(True)),
        "symbols": _share(text, SYMBOLS) > MAX_SYMBOLS,
        "capitals": _share(text, CAPITALS) > MAX_CAPITALS,
        "digits": _share(text, DIGITS) > MAX_DIGITS,
        "long_words": F.length(text) / (gaps + 1) > MAX_WORD_CHARS,
        "repeated_lines": (F.size(lines) - F.size(F.array_distinct(lines))) / F.size(lines) > MAX_REPEATED_LINES,
        "repeated_words": again / F.size(words) > MAX_REPEATED_WORDS,
    }


def measure(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, repeats: int = 3) -> list[tuple[str, float, float]]:
    """(rule, cost in seconds, share rejected) on a random sample, best rejection per cost first.

    The sample is drawn where the rows are and only then brought into a few tasks. A rule's cost is the time of a job
    over the sample less that of a job without a rule. The sample only sets the order, never a decision. An empty
    table keeps the order of `rules`.
    """
    rows = docs.count()  # of a Parquet table from its footers
    texts = docs.select(quoted(text_col).cast("string").alias("t"))
    sample = texts.sample(fraction=sample_rows / rows, seed=7) if rows > sample_rows else texts
    sample = sample.repartition(SAMPLE_TASKS).persist()

    def timed(count: Column) -> tuple[float, int]:
        cost, hits = float("inf"), 0
        for _ in range(repeats):
            began = time.perf_counter()
            hits = sample.agg(count).first()[0]
            cost = min(cost, time.perf_counter() - began)
        return cost, hits

    try:
        idle, held = timed(F.count(F.when(F.coalesce(F.length("t") >= 0, F.lit(True)), 1)))
        found = []
        for name, rejects in rules(F.col("t")).items():
            cost, hits = timed(F.count(F.when(rejects, 1)))
            found.append((name, max(cost - idle, 1e-3), hits / max(1, held)))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda r: -r[2] / r[1])


def first_failed(text: Column, order: list[str]) -> Column:
    """Name of the first rule in this order that rejects the text, null for a text that passes all."""
    expr, table = F, rules(text)
    for name in order:
        expr = expr.when(table[name], F.lit(name))
    return expr


def keep_quality(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without the rows that a rule rejects, all columns as they were.

    Null, empty and blank texts are rejected; very long texts are judged whole; repeated rows are judged one by
    one and all stay or all go; nulls in other columns and extra columns (whatever their names) pass through;
    an empty table stays empty.
    """
    order = [name for name, _, _ in measure(docs, text_col, sample_rows)]
    return docs.where(first_failed(quoted(text_col).cast("string"), order).isNull())


def oracle_sql(table: str = "documents") -> str:
    sql_share = lambda chars: f"(length(text) - length(translate(text, '{chars}', ''))) / length(text)"
    return f"""
SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, string_split(replace(text, chr(10), ' '), ' ') AS w, string_split(text, chr(10)) AS l FROM {table} WHERE length(trim(text)) > 0)
WHERE {sql_share(SYMBOLS)} <= {MAX_SYMBOLS} AND {sql_share(CAPITALS)} <= {MAX_CAPITALS} AND {sql_share(DIGITS)} <= {MAX_DIGITS}
  AND length(text) / (length(text) - length(translate(text, ' ' || chr(10), '')) + 1) <= {MAX_WORD_CHARS}
  AND (len(l) - len(list_distinct(l))) / len(l) <= {MAX_REPEATED_LINES}
  AND len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) / len(w) <= {MAX_REPEATED_WORDS}"""
