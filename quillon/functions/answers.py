"""Parsing of responses and scoring of answers as column expressions (SCR-1 .. SCR-13)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is dropped from an answer.
_PUNCTUATION = "[_*#@$%^&()+=\\[\\]{}|\\\\:\";'<>?/~`]"
# What counts as a bullet and as a connective in a response.
BULLETS = ("•", "-", "*", "1.", "2.", "3.")
CONNECTIVES = ("because", "therefore", "since", "thus", "shows", "indicates")
TRUNCATED = "\n... [truncated for memory efficiency]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once: expressions that name it often do not repeat its code."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def clean_answer(text: Column) -> Column:
    """SCR-1: the set of cleaned items of an answer, as a sorted array."""

    def items(low: Column) -> Column:
        return F.when(F.contains(low, F.lit(";")), F.split(low, ";")).when(F.contains(low, F.lit(",")), F.split(low, ",")).otherwise(F.array(low))

    # The expressions of this chain and their order decide what counts as equal.
    def clean(i: Column) -> Column:
        i = squeeze(F.regexp_replace(F.trim(i), _PUNCTUATION, ""))
        i = F.regexp_replace(F.regexp_replace(i, "\\s+[0-9]{4}$", ""), "\\s+[0-9]{4}\\s+", " ")
        return squeeze(F.regexp_replace(F.regexp_replace(i, "^[0-9]+$", ""), "[^a-z0-9\\s]", ""))

    cut = let(F.regexp_replace(F.trim(F.lower(text)), "\\s+", " "), items)
    return F.array_sort(F.array_distinct(F.filter(F.transform(cut, clean), lambda i: i != "")))


def jaccard(expected: Column, actual: Column, answer_type: Column) -> Column:
    """SCR-2 on cleaned sets: two empty sets agree; a BIN answer is right or wrong."""

    def score(pair: Column) -> Column:
        both, either = F.size(F.array_intersect(pair["e"], pair["a"])), F.size(F.array_union(pair["e"], pair["a"]))
        return F.when(either == 0, 1.0).otherwise(F.try_divide(both.cast("double"), either.cast("double")))

    found = let(F.struct(expected.alias("e"), actual.alias("a")), score)
    return let(found, lambda x: F.when((answer_type == "BIN") & (x < 1.0), 0.0).otherwise(x))


def calibration(confidence: Column, accuracy: Column) -> Column:
    """SCR-3"""
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    return F.lit(1.0) - F.abs(bounded - F.when(accuracy >= 1.0, 1.0).otherwise(0.0))


def parse_answers(text: Column) -> Column:
    """SCR-5: the cleaned answers of a text in their order, with repeats."""

    def items(low: Column) -> Column:
        return F.when(F.contains(low, F.lit(";")), F.split(low, ";")).when(F.contains(low, F.lit(",")), F.split(low, ",")).when(F.contains(low, F.lit("\n")), F.split(low, "\n")).otherwise(F.array(low))

    return F.filter(F.transform(let(F.trim(F.lower(text)), items), lambda i: squeeze(F.regexp_replace(i, "(?U)[^\\w\\s]", ""))), lambda i: i != "")


def valid_entities(context: Column, expected: Column) -> Column:
    """SCR-6: expected answers and the individuals, capitalised words and IRI fragments of a context."""
    people = F.regexp_extract_all(F.lower(context), F.lit("(?U)\\b[a-z]+(?:_[a-z]+)*_[0-9]{4}\\b"), F.lit(0))
    classes = F.transform(F.regexp_extract_all(context, F.lit("(?U)\\b[A-Z][a-zA-Z]+\\b"), F.lit(0)), F.lower)
    iris = F.transform(F.regexp_extract_all(context, F.lit("<[^>]+#([^>]+)>"), F.lit(1)), F.lower)
    return F.array_distinct(F.concat(expected, F.when(context.isNull(), F.array().cast("array<string>")).otherwise(F.concat(people, classes, iris))))


def normal_answer(c: Column) -> Column:
    """SCR-7"""
    return squeeze(F.regexp_replace(F.replace(F.trim(F.lower(c)), F.lit("_"), F.lit(" ")), "\\s*[0-9]{4}$", ""))


def answers_match(a: Column, b: Column) -> Column:
    """SCR-7: either holds the other, with or without blanks."""
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    return F.contains(a, b) | F.contains(b, a) | (bare(a) == bare(b))


def hallucination_rate(actual: Column, expected: Column, context: Column, answer_type: Column) -> Column:
    """SCR-4: share of answers that match no valid entity; null for BIN, 1 without answers."""
    both = F.struct(F.transform(parse_answers(actual), normal_answer).alias("mine"), F.transform(let(parse_answers(expected), lambda e: valid_entities(context, e)), normal_answer).alias("valid"))

    def share(x: Column) -> Column:
        wrong = F.size(F.filter(x["mine"], lambda a: ~F.exists(x["valid"], lambda v: answers_match(a, v))))
        return F.when(F.size(x["mine"]) == 0, 1.0).otherwise(F.try_divide(wrong.cast("double"), F.size(x["mine"]).cast("double")))

    return F.when(answer_type == "BIN", F.lit(None).cast("double")).otherwise(let(both, share))


def final_answer(response: Column, answer_type: Column) -> Column:
    """SCR-8"""
    kind = F.lower(answer_type)

    def read(answer: Column) -> Column:
        # The expressions that bare a local name, in this order.
        local = F.regexp_replace(answer, "<[^#]*#([^>]+)>", "$1")
        local = F.regexp_replace(local, "[^#]*#([^,\\s]+)", "$1")
        for prefix in ("ns1", "rdf", "rdfs", "owl"):
            local = F.regexp_replace(local, prefix + ":([^,\\s]+)", "$1")
        low = F.lower(answer)
        binary = F.when(F.contains(low, F.lit("true")), "TRUE").when(F.contains(low, F.lit("false")), "FALSE").otherwise(answer)
        return F.when(kind.isin("mc", "multi choice"), F.trim(local)).when(kind.isin("bin", "binary"), binary).otherwise(answer)

    told = F.regexp_extract(response, "(?i)ANSWER:\\s*([^\\n\\r]+)", 1)
    first = F.trim(F.split(F.regexp_replace(response, "^\\s+", ""), "\n")[0])
    answer = let(told, lambda t: F.when(t != "", F.trim(t)).otherwise(first))
    failed = response.isNull() | (response == "") | F.contains(response, F.lit("[ERROR]"))
    return F.when(failed, "ERROR").otherwise(let(answer, read))


def confidence(response: Column) -> Column:
    """SCR-9: 0.5 where none is given, within 0 and 1."""
    got = F.regexp_extract(response, "(?i)CONFIDENCE:\\s*([0-9]*\\.?[0-9]+)", 1).try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(got, F.lit(0.5))))


def reasoning_steps(response: Column) -> Column:
    """SCR-10: 1 where none is given, within 1 and 10."""
    got = F.regexp_extract(response, "(?i)REASONING_STEPS:\\s*([0-9]+)", 1).try_cast("int")
    return F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(got, F.lit(1))))


def _terms(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.replace(c, F.lit(","), F.lit(" ")), F.lit("(?U)\\w+"), F.lit(0)))


def correctness(expected: Column, extracted: Column, answer_type: Column) -> Column:
    """SCR-11: BIN by equality; MC by containment either way, else by shared terms."""

    def shared(t: Column) -> Column:
        share = F.try_divide(F.size(F.array_intersect(t["e"], t["x"])).cast("double"), F.size(F.array_union(t["e"], t["x"])).cast("double"))
        return F.when((F.size(t["e"]) > 0) & (F.size(t["x"]) > 0), share).otherwise(0.0)

    def score(p: Column) -> Column:
        e, x = p["e"], p["x"]
        mc = F.when(F.contains(x, e) | F.contains(e, x), 1.0).otherwise(let(F.struct(_terms(e).alias("e"), _terms(x).alias("x")), shared))
        return F.when(answer_type == "BIN", F.when(e == x, 1.0).otherwise(0.0)).when(answer_type == "MC", mc).otherwise(0.0)

    return let(F.struct(F.trim(F.lower(F.coalesce(expected, F.lit("")))).alias("e"), F.trim(F.lower(F.coalesce(extracted, F.lit("")))).alias("x")), score)


def words(c: Column) -> Column:
    t = squeeze(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def completeness(response: Column) -> Column:
    n = words(response)
    return F.when((n >= 20) & (n <= 50), 1.0).when((n >= 10) & (n < 20), 0.8).when(n > 50, 0.6).otherwise(0.3)


def structure(response: Column) -> Column:
    a, b = response.rlike("(?i)ANSWER:\\s*[^\\n]+"), response.rlike("(?i)REASONING:\\s*[^\\n]+")
    return F.when(a & b, 1.0).when(a | b, 0.5).otherwise(0.0)


def reasoning_quality(response: Column) -> Column:
    kinds = lambda c, of: sum((F.contains(c, F.lit(w)).cast("int") for w in of[1:]), F.contains(c, F.lit(of[0])).cast("int"))
    return F.least(F.lit(1.0), kinds(response, BULLETS) * 0.3 + kinds(F.lower(response), CONNECTIVES) * 0.2)


def normal_query(c: Column) -> Column:
    """SCR-13: single blanks, no dots or blanks at the end."""
    return F.regexp_replace(squeeze(c), "[. ]+$", "")


def truncated(c: Column, most: int) -> Column:
    """SRC-13, SCR-15: long contexts end in a remark."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(TRUNCATED))).otherwise(c)


def normal_answer_type(c: Column) -> Column:
    """PRJ-14: every spelling of the two kinds; anything else is BIN."""
    low = F.trim(F.lower(c))
    return F.when(low.isin("multi choice", "mc", "multichoice"), "MC").otherwise("BIN")


def strict_answer_type(c: Column) -> Column:
    """PRJ-14, strict: an unknown kind is an error."""
    low = F.trim(F.lower(c))
    return F.when(low.isin("multi choice", "mc", "multichoice"), "MC").when(low.isin("bin", "binary"), "BIN").otherwise(F.raise_error(F.concat(F.lit("unknown answer type: "), F.coalesce(c, F.lit("null")))))


_ASK = {"BIN": "TRUE or FALSE, nothing else", "MC": "all local names that answer it, separated by commas", "OTHER": "your answer in local names"}


def clean_kind(c: Column) -> Column:
    """The kind of a prompt's answer: BIN, MC or, for any other type, OTHER."""
    low = F.trim(F.lower(c))
    return F.when(low.isin("multi choice", "mc", "multichoice"), "MC").when(low.isin("bin", "binary"), "BIN").otherwise("OTHER")


def prompt(question: Column, context: Column, answer_type: Column, mode: str) -> Column:
    """SCR-15: task, answer form, question and context (at most 10 000 characters of it)."""
    kind = clean_kind(answer_type)
    form = F.when(kind == "MC", _ASK["MC"]).when(kind == "BIN", _ASK["BIN"]).otherwise(_ASK["OTHER"])
    task = "Answer the SPARQL query from the Turtle ontology below." if mode == "ttl" else "Answer the question from the statements below; infer what follows from them."
    lines = F.concat(F.lit(f"{task}\nReply in exactly three lines:\nANSWER: ["), form, F.lit("]\nCONFIDENCE: [0.0 to 1.0]\nREASONING_STEPS: [1 to 10]\n\nQuestion: "))
    return F.concat(lines, question, F.lit("\nContext: "), truncated(context, 10_000))


def question_prompt(query: Column, answer_type: Column, task: Column) -> Column:
    """SCR-16: asks for a question in plain English that says what the query asks."""
    what = F.when(normal_answer_type(answer_type) == "BIN", "a yes-or-no question").when(task == "Membership", "a question for all classes of the individual").otherwise("a question for all individuals so related")
    return F.concat(F.lit("Write "), what, F.lit(" in English for this SPARQL query, and nothing else.\nQuery: "), query)


def metrics(query: Column, response: Column, seconds: Column, tokens: Column) -> Column:
    """SCR-12: the logged figures of a call."""
    return F.struct(
        F.substring(F.md5(query), 1, 8).alias("query_hash"), F.length(response).alias("response_chars"), words(response).alias("response_words"), F.round(seconds, 3).alias("response_time"), tokens.alias("token_count"),
        F.round(F.coalesce(F.try_divide(tokens.cast("double"), seconds), F.lit(0.0)), 3).alias("tokens_per_second"), F.substring(response, 1, 500).alias("response"),
    )
