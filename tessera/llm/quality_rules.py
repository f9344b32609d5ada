"""Quality rules: a threshold table compiled into one projection over a text, evaluated without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, empty_if_null, free_name

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Frequent function words of the four languages, lower case.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he his at are this have or from "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le et les des en un une du que est pour qui dans par sur au avec pas "
    "el que y a los se del las un por con no una su para es al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if low <= value(metric) <= high; a bound of None does not apply, a null value passes."""

    metric: str
    low: float | None = None
    high: float | None = None


#: Ratios are per word or per line; see metrics().
RULES = (
    Rule("n_words", low=10),
    Rule("mean_word_chars", low=2, high=14),
    Rule("symbols_per_word", high=0.1),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.3),
    Rule("upper_ratio", high=0.5),
    Rule("repeat_word_ratio", high=0.2),
)


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def _repeated(grams: Column) -> Column:
    """Places, in rising order, of the window hashes that occur twice or more."""
    placed = F.array_sort(F.arrays_zip(grams.alias("h"), F.sequence(F.lit(0), F.size(grams) - 1).alias("i")))
    inner = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.size(grams) - 1),
            lambda k: F.when(
                ((k > 0) & (F.get(F.col("__placed"), k - 1)["h"] == F.get(F.col("__placed"), k)["h"])) | (F.get(F.col("__placed"), k + 1)["h"] == F.get(F.col("__placed"), k)["h"]),
                F.get(F.col("__placed"), k)["i"],
            ),
        ),
        lambda x: x.isNotNull(),
    )
    return placed, F.array_sort(inner)


#: Columns that stand only while metrics() is made; those of docs with these names are set aside meanwhile.
HELPERS = ("__t", "__w", "__lines", "__g", "__placed", "__p")


def metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and the ratios of the rules.

    Null texts count as empty; a text without words has null ratios. n_repeat_words counts the words covered by windows
    of five words that occur twice or more in the text, the first occurrence included. Windows are compared by a 64-bit
    hash within one text. Columns of docs with these names are replaced.
    """
    names = {c: free_name(docs, c + "_") for c in docs.columns if c.lower() in HELPERS}
    d = docs.withColumn("__t", empty_if_null(text_col)) if not names else docs.withColumnsRenamed(names).withColumn("__t", empty_if_null(names.get(text_col, text_col)))
    d = d.withColumn("__w", _words(F.col("__t")))
    d = d.withColumn("n_words", F.size("__w").cast("long"))
    d = d.withColumn("word_chars", F.length(F.translate("__t", SPACES, "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long"))
    d = d.withColumn("__lines", F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    d = d.withColumn("n_lines", F.size("__lines").cast("long")).withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    w = F.col("__w")
    grams = F.when(
        F.size(w) > WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("__g", grams)
    some = F.size(F.array_distinct("__g")) < F.size("__g")
    placed, places = _repeated(F.col("__g"))
    d = d.withColumn("__placed", F.when(some, placed)).withColumn("__p", F.when(some, places))
    covered = F.aggregate(
        F.col("__p"),
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, x: F.struct((acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("n"), x.alias("last")),
        lambda acc: acc["n"],
    )
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    n = F.nullif(F.col("n_words"), F.lit(0).cast("long"))
    stops = F.size(F.filter("__w", lambda x: F.lower(x).isin(STOP_WORDS)))
    upper = F.length("__t") - F.length(F.regexp_replace("__t", r"\p{Lu}", ""))
    d = d.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / n,
            "symbols_per_word": F.col("n_symbols") / n,
            "stop_word_ratio": stops / n,
            "dup_line_ratio": F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0).cast("long")),
            "upper_ratio": upper / F.nullif(F.col("word_chars"), F.lit(0).cast("long")),
            "repeat_word_ratio": F.col("n_repeat_words") / n,
        }
    )
    return d.drop(*HELPERS).withColumnsRenamed({v: k for k, v in names.items()})


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The whole table as one boolean expression."""
    verdict = F.lit(True)
    for r in rules:
        value = F.col(r.metric)
        if r.low is not None:
            verdict = verdict & F.coalesce(value >= r.low, F.lit(True))
        if r.high is not None:
            verdict = verdict & F.coalesce(value <= r.high, F.lit(True))
    return verdict


#: Columns that quality_rules() adds.
ADDED = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "mean_word_chars", "symbols_per_word", "stop_word_ratio",
    "dup_line_ratio", "upper_ratio", "repeat_word_ratio", "base_failed", "kept",
)


def quality_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """metrics() plus base_failed (fewer than 10 words, or over 20 % repeated words) and kept. Repeated rows give repeated
    rows; an empty table gives an empty result.

    The added columns leave as one generated row for each document, so a filter by them stays behind the projection and is
    not copied into it.
    """
    others = [c for c in docs.columns if c.lower() not in ADDED]
    d = metrics(docs, text_col)
    d = d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    d = d.withColumn("kept", ~F.col("base_failed") & compiled(rules))
    return d.select(*others, F.inline(F.array(F.struct(*ADDED))))


def rules_sql(columns: str, rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB form over documents: the base columns through unnested words and windows, then the same table of rules."""
    cond = " and ".join(
        f"coalesce({r.metric} {op} {bound!r}, true)" for r in rules for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None
    )
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
with t as (select doc_id, coalesce(text, '') as t from documents),
words as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from t),
wins as (select doc_id, i, list_slice(w, i, i + {WINDOW - 1}) as g
         from (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from words where len(w) > {WINDOW})),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from wins) where c > 1),
cov as (select doc_id, sum(least({WINDOW}, nxt - i)) as n from
        (select doc_id, i, coalesce(lead(i) over (partition by doc_id order by i), i + {WINDOW}) as nxt from rep) group by doc_id),
m as (select doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(lines)::bigint as n_lines,
             (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
             len(list_filter(w, lambda x: lower(x) in ({stops}))) as stops,
             length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) as uppers
      from words left join cov using (doc_id)),
r as (select *, word_chars::double / nullif(n_words, 0) as mean_word_chars, n_symbols::double / nullif(n_words, 0) as symbols_per_word,
             stops::double / nullif(n_words, 0) as stop_word_ratio, n_dup_lines::double / nullif(n_lines, 0) as dup_line_ratio,
             uppers::double / nullif(word_chars, 0) as upper_ratio, n_repeat_words::double / nullif(n_words, 0) as repeat_word_ratio from m),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from r)
select {columns} from (select *, not base_failed and {cond} as kept from b)
"""
