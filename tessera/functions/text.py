"""Column builders of the scalar layer: sentences, tokens, names, dates, intents. JVM expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

#: White space as Unicode has it, control separators included, and its complement.
WS = r"[\t-\r\x1c-\x1f \x85\p{Z}]"
NOT_WS = r"[^\t-\r\x1c-\x1f \x85\p{Z}]"
SENTENCE = rf"(?s).*?(?:[.!?。！？]{WS}+|\z)"
STRIPPED = "\"'(),.!?;:"


def strip(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(x, rf"\A{WS}+", ""), rf"{WS}+\z", "")


def is_blank(x: Column) -> Column:
    return ~x.rlike(NOT_WS)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def sentence_spans(x: Column) -> Column:
    """Sentences with the white space behind them; joined they are the text. An empty text is one empty sentence."""
    found = F.filter(F.regexp_extract_all(x, F.lit(SENTENCE), F.lit(0)), lambda s: s != "")
    return let(found, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.lit(""))))


def split_sentences(x: Column) -> Column:
    """Sentences without the white space between them, blank ones dropped; the whole text if none is left."""
    cut = F.transform(sentence_spans(x), lambda s: F.regexp_replace(s, rf"([.!?。！？]){WS}+\z", "$1"))
    return let(F.filter(cut, lambda s: s.rlike(NOT_WS)), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(F.array(x)))


def token_count(x: Column) -> Column:
    """Estimate of a text's tokens."""
    cjk = F.regexp_count(x, F.lit("[一-鿿]"))
    return (F.floor(cjk * F.lit(1.5) + (F.length(x) - cjk) / F.lit(4.0)) + 1).cast("int")


def tokens(x: Column) -> Column:
    """Runs of a-z, 0-9 and apostrophes of two characters or more, lower-cased."""
    return F.filter(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9']+"), F.lit(0)), lambda t: F.length(t) > 1)


def split_long(x: Column, max_tokens: int = C.SEGMENT_MAX_TOKENS) -> Column:
    """Pieces of at most max_tokens cut at sentence ends; a single longer sentence stays whole. The fold runs over the
    sentences' token counts and yields the places of the cuts; text is joined once."""

    def step(acc: Column, t: Column) -> Column:
        full = (acc["i"] > 0) & (acc["n"] + t > max_tokens)
        return F.struct(
            F.when(full, F.concat(acc["cuts"], F.array(acc["i"]))).otherwise(acc["cuts"]).alias("cuts"),
            F.when(full, t).otherwise(acc["n"] + t).alias("n"),
            (acc["i"] + 1).alias("i"),
        )

    def pieces(s: Column) -> Column:
        start = F.struct(F.array(F.lit(0)).alias("cuts"), F.lit(0).alias("n"), F.lit(0).alias("i"))
        cuts = F.aggregate(F.transform(s, token_count), start, step, lambda acc: F.concat(acc["cuts"], F.array(acc["i"])))
        join = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda k: F.array_join(F.slice(s, F.get(c, k - 1) + 1, F.get(c, k) - F.get(c, k - 1)), ""))
        return let(cuts, join)

    kept = F.filter(let(sentence_spans(x), pieces), lambda p: p.rlike(NOT_WS))
    long = let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(x)))
    return F.when(token_count(x) <= max_tokens, F.array(x)).otherwise(long)


def speaker_prefix(x: Column) -> Column:
    """The capitalised word before a leading colon, null if there is none or it is a label."""
    name = F.regexp_extract(x, rf"\A([A-Z][a-zA-Z]{{1,20}}):{WS}", 1)
    return F.when((name != "") & ~name.isin(C.NOT_SPEAKERS), name)


def _anywhere(words: list[str], cjk: list[str]) -> str:
    return rf"(?iuU)\b(?:{'|'.join(words)})\b" + "".join("|" + w for w in cjk)


def looks_like_rule(x: Column, role: Column) -> Column:
    """A short standing instruction of the user."""
    return (role == "user") & (F.length(x) <= C.RULE_MAX_CHARS) & x.rlike(_anywhere(C.RULE_PHRASES, C.RULE_ANYWHERE))


def content_sha(role: Column, x: Column) -> Column:
    """G11."""
    return F.substring(F.sha2(F.concat(role, F.lit("\n"), x), 256), 1, 24)


def date_strings(ts: Column) -> Column:
    """The ways of writing a date that the index holds; empty for null."""
    month = F.date_format(ts, "MMMM")
    day, year = F.dayofmonth(ts).cast("string"), F.year(ts).cast("string")
    parts = F.array(
        F.date_format(ts, "yyyy-MM-dd"), F.concat_ws(" ", month, year), F.concat_ws(" ", month, day, year), F.concat_ws(" ", day, month, year), F.date_format(ts, "E")
    )
    return F.when(ts.isNull(), F.array().cast("array<string>")).otherwise(parts)


def index_text(speaker: Column, role: Column, ts: Column, x: Column) -> Column:
    """Who, the date strings and the text, joined by spaces."""
    return F.concat_ws(" ", F.array(F.coalesce(speaker, role)), date_strings(ts), F.array(x))


def names(x: Column) -> Column:
    """Capitalised words that do not open a sentence, repeats and order kept."""

    def of_sentence(s: Column) -> Column:
        words = F.filter(F.split(s, WS + "+"), lambda w: w != "")
        bare = F.transform(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: F.btrim(w, F.lit(STRIPPED)))
        return F.filter(bare, lambda w: w.rlike(r"\A[A-Z][a-z]{2,}\z") & ~w.isin(C.NOT_NAMES))

    return F.flatten(F.transform(split_sentences(x), of_sentence))


def row_names(x: Column, speaker: Column) -> Column:
    """The names of a text, then its speaker."""
    return F.concat(names(x), F.when(speaker.isNotNull(), F.array(speaker)).otherwise(F.array().cast("array<string>")))


def bigrams(x: Column) -> Column:
    """The set of neighbouring character pairs, lower-cased."""
    low = F.lower(x)
    pairs = F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.substring(low, i, F.lit(2)))
    return F.when(F.length(low) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def alike(la: Column, ba: Column, lb: Column, bb: Column) -> Column:
    """I10 for two names in lower case and their bigrams."""
    shared = F.size(F.array_intersect(ba, bb)) * 2 >= F.least(F.size(ba), F.size(bb))
    return F.contains(la, lb) | F.contains(lb, la) | ((F.size(ba) > 0) & (F.size(bb) > 0) & shared)


def same_person(a: Column, b: Column) -> Column:
    """Equal, one within the other, or half of the fewer bigrams shared; case does not count."""
    return alike(F.lower(a), bigrams(a), F.lower(b), bigrams(b))


_MONTH = "|".join(C.MONTHS + [m[:3] for m in C.MONTHS])
_EDGE = r"(?iuU)\b"
DAY_ISO = r"(?U)\b([0-9]{4})-([0-9]{2})-([0-9]{2})\b"
DAY_MDY = rf"{_EDGE}({_MONTH})\.?{WS}+([0-9]{{1,2}})(?:st|nd|rd|th)?,?{WS}+([0-9]{{4}})\b"
DAY_DMY = rf"{_EDGE}([0-9]{{1,2}})(?:st|nd|rd|th)?{WS}+({_MONTH})\.?,?{WS}+([0-9]{{4}})\b"
MONTH_Y = rf"{_EDGE}({_MONTH})\.?{WS}+([0-9]{{4}})\b"


def month_number(name: Column) -> Column:
    """Q07: by the first three letters."""
    at = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(name, 1, 3)))
    return ((at + 2) / 3).cast("int")


def _days(x: Column, pattern: str, y: int, m: int, d: int) -> Column:
    whole = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    part = lambda s, k: F.regexp_extract(s, pattern, k)

    def day(s: Column) -> Column:
        month = part(s, m)
        number = month if pattern is DAY_ISO else F.lpad(month_number(month).cast("string"), 2, "0")
        return F.try_to_date(F.concat_ws("-", part(s, y), number, F.lpad(part(s, d), 2, "0")), "yyyy-MM-dd")

    return F.filter(F.transform(whole, day), lambda v: v.isNotNull() & (v >= F.lit("0001-01-01").cast("date")))


def query_days(x: Column) -> Column:
    """Q06: calendar days named in a text, in the order of the patterns; impossible ones are skipped."""
    return F.concat(_days(x, DAY_ISO, 1, 2, 3), _days(x, DAY_MDY, 3, 1, 2), _days(x, DAY_DMY, 3, 2, 1))


def query_months(x: Column) -> Column:
    """Q06: months named with a year, as yyyy-MM; the year is not checked."""
    whole = F.regexp_extract_all(x, F.lit(MONTH_Y), F.lit(0))
    return F.transform(whole, lambda s: F.concat_ws("-", F.regexp_extract(s, MONTH_Y, 2), F.lpad(month_number(F.regexp_extract(s, MONTH_Y, 1)).cast("string"), 2, "0")))


def literal_terms(x: Column) -> Column:
    """Q05: names, numbers and dates that a query wants verbatim; distinct, of two characters or more, sorted."""
    numbers = F.regexp_extract_all(x, F.lit(r"(?U)\b[0-9][0-9.,:/-]*\b"), F.lit(0))
    days = F.transform(query_days(x), lambda d: F.date_format(d, "yyyy-MM-dd"))
    return F.array_sort(F.filter(F.array_distinct(F.concat(names(x), numbers, days, query_months(x))), lambda t: F.length(t) > 1))


def intent(query: Column) -> Column:
    """Q01: the first intent whose words occur."""
    out = F.lit("default")
    for name, (words, cjk) in reversed(C.INTENTS.items()):
        out = F.when(query.rlike(_anywhere(words, cjk)), F.lit(name)).otherwise(out)
    return out


def is_aggregate(query: Column) -> Column:
    """Q02: whatever the routed intent."""
    return query.rlike(_anywhere(*C.INTENTS["aggregate"]))


def is_task_request(query: Column) -> Column:
    """Q03: asks for something to be done and does not open like a factual question."""
    task = rf"(?iuU)\A{WS}*(?:please{WS}+)?(?:{'|'.join(C.TASK_OPENERS)})\b" + "".join("|" + w for w in C.TASK_ANYWHERE)
    factual = rf"(?iuU)\A{WS}*(?:{'|'.join(C.FACTUAL_OPENERS)})\b"
    return query.rlike(task) & ~query.rlike(factual)


def expand(query: Column, options: Column) -> Column:
    """Q04: the query with its options behind it."""
    return F.when(F.size(F.coalesce(options, F.array().cast("array<string>"))) > 0, F.concat_ws(" ", F.array(query), options)).otherwise(query)


def date_header(ts: Column, granularity: Column, label: Column) -> Column:
    """F07."""
    clock = F.concat(F.date_format(ts, " HH:mm"), F.when(F.second(ts) != 0, F.date_format(ts, ":ss")).otherwise(F.lit("")))
    known = F.concat(F.date_format(ts, "yyyy-MM-dd (E)"), F.when(granularity == "datetime", clock).otherwise(F.lit("")))
    return F.concat(F.lit("["), F.when(ts.isNull(), F.concat(F.lit("date unknown · "), label)).otherwise(known), F.lit("]"))


def created_at(ts: Column, granularity: Column) -> Column:
    """as exact as the source was."""
    millis = F.date_format(ts, "SSS")
    micros = F.date_format(ts, "SSSSSS")
    exact = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", F.lit("Z")).otherwise(F.concat(F.lit("."), millis, F.lit("Z"))))
    return F.when(granularity == "datetime", exact).otherwise(F.date_format(ts, "yyyy-MM-dd"))


def render(ts: Column, granularity: Column, label: Column, speaker: Column, role: Column, part: Column, total: Column, x: Column) -> Column:
    """header, who, part marker and the text without a repeated speaker."""
    repeats = speaker.isNotNull() & F.startswith(x, F.concat(speaker, F.lit(":")))
    body = F.when(repeats, F.regexp_replace(F.substring(x, F.length(speaker) + 2, F.length(x)), rf"\A{WS}+", "")).otherwise(x)
    marker = F.when(total > 1, F.concat(F.lit(" (part "), part.cast("string"), F.lit("/"), total.cast("string"), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(date_header(ts, granularity, label), F.lit(" "), F.coalesce(speaker, role), F.lit(":"), marker, F.lit(" "), body)
