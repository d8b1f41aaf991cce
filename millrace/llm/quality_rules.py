"""Quality rules, line first, in DataFrame expressions only.

Each line of a text is judged by itself; a line fails when

* punctuation: no sentence ends anywhere in it (`.`, `!`, `?`, their wide forms or an ellipsis, before a space, a
  closing mark or the line's end);
* navigation: it has two or more separators (`|`, `>`, guillemets, bullets), at least one for every four words;
* symbols: more than a tenth of its characters (white space aside) are of `#*$%&|<>`;
* boilerplate: it is of at most BOILERPLATE_WORDS words and holds one of BOILERPLATE.

Failing lines are removed. A document is rejected when more than half of its characters (white space aside) go with
them, or when it fails as a whole: fewer than 20 words, or more than 30 % of its words in repeated windows of eight.

Every measure is an expression over the row itself: no shuffle, no Python, and memory for one text at a time.

Defined results: a null text is an empty one (no words, rejected); lines without a word are neither kept nor lost;
repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|>»›•·"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT, BOILERPLATE_WORDS = 8, 20, 30, 30
SENTENCE_END = r"""[.!?…。！？](["')\]”’»]|[\x20\x09-\x0D]|$)"""
BOILERPLATE = "(?i)(licensed under|all rights reserved|copyright|terms of use|terms of service|privacy policy|cookie|javascript|lorem ipsum|subscribe|click here|read more|sign in|log in)"


def _without(text: F.Column | str, characters: str) -> F.Column:
    """How many characters of the text are in `characters`."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _visible(text: F.Column | str) -> F.Column:
    """Characters that are no white space."""
    return F.length(F.translate(text, " \t\n\x0b\f\r", ""))


def line_fails(line: F.Column) -> F.Column:
    """Whether a line that has words is to be removed."""
    words = F.regexp_count(line, F.lit(WORD))
    separators = _without(line, SEPARATORS)
    return (
        ~line.rlike(SENTENCE_END)
        | ((separators >= 2) & (separators * 4 >= words))
        | (_without(line, SYMBOLS) * 10 > _visible(line))
        | ((words <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE))
    )


def measured(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, cleaned (the text without
    failing lines), base_failed and kept; input columns of those names are replaced."""
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "cleaned", "base_failed", "kept")
    keep = [c for c in docs.columns if c not in made]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)))
    rows = rows.withColumn("_hashes", F.transform(F.array_remove(F.split("_text", SPACE), ""), lambda w: F.xxhash64(w)))
    # one hash for each window of eight words, and the windows by hash only where two are equal
    rows = rows.withColumn("_windows", F.expr(f"IF(size(_hashes) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, size(_hashes) - {WINDOW}), i -> xxhash64({', '.join(f'_hashes[i + {k}]' for k in range(WINDOW))})))"))
    rows = rows.withColumn("_sorted", F.expr("IF(size(array_distinct(_windows)) < size(_windows), sort_array(transform(_windows, (h, i) -> struct(h, i))), null)"))
    rows = rows.withColumn("_places", F.expr("sort_array(transform(filter(_sorted, (x, k) -> x.h <=> get(_sorted, k - 1).h OR x.h <=> get(_sorted, k + 1).h), x -> x.i))"))
    covered = F.expr(f"coalesce(aggregate(_places, struct(0 as n, 0 as upto), (a, p) -> struct(a.n + {WINDOW} - greatest(a.upto - p, 0) as n, p + {WINDOW} as upto), a -> a.n), 0)")
    rows = rows.withColumn("_kept", F.filter("_lines", lambda x: ~line_fails(x)))
    n_words = F.size("_hashes").cast("long")
    rows = rows.select(
        "_row", n_words.alias("n_words"), _visible("_text").cast("long").alias("word_chars"), _without("_text", SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"), F.concat_ws("\n", "_kept").alias("cleaned"),
    )
    rows = rows.withColumn("lost_chars", F.col("word_chars") - _visible("cleaned").cast("long"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") * 2 <= F.col("word_chars")))
    return rows.select(*(F.col(f"_row.`{c}`") for c in keep), *made)


def rule_verdicts(docs: DataFrame) -> DataFrame:
    """The columns of query op8, and lost_chars."""
    return measured(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


_S = r"\x20\x09-\x0D"
_FAILS = f"""(NOT regexp_matches(l, '[.!?…。！？](["'')\\]”’»]|[{_S}]|$)')
  OR (length(l) - length(translate(l, '{SEPARATORS}', '')) >= 2 AND (length(l) - length(translate(l, '{SEPARATORS}', ''))) * 4 >= len(regexp_extract_all(l, '[^{_S}]+')))
  OR (length(l) - length(translate(l, '{SYMBOLS}', ''))) * 10 > length(regexp_replace(l, '[{_S}]+', '', 'g'))
  OR (len(regexp_extract_all(l, '[^{_S}]+')) <= {BOILERPLATE_WORDS} AND regexp_matches(l, '{BOILERPLATE}')))"""
#: Query op8 in SQL.
SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
word AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^{_S}]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^{_S}]')) AS lines FROM doc),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS run FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM word WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM win) WHERE n > 1),
again AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
line AS (SELECT r, sum(length(regexp_replace(l, '[{_S}]+', '', 'g'))) FILTER (WHERE {_FAILS}) AS lost FROM (SELECT r, unnest(lines) AS l FROM word) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[{_S}]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars
  FROM word LEFT JOIN again USING (r) LEFT JOIN line USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND lost_chars * 2 <= word_chars AS kept, lost_chars
FROM m
"""
