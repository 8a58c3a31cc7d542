"""License scans by ordered signature rules, with DataFrame functions only (operator 9).

The rules (``license_rules``) run over a text's words (lower case, one blank between them).  A text without any GATE
word runs no rule, and a rule runs only where one of its own keywords stands; every match of a rule holds one of its keywords
and every keyword a gate word, so neither filter loses a match.  Of the spans found, those inside another span go
(of equal spans the higher priority stays, then the first label); of those that overlap, the higher priority stays, whichever comes first.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table
from quillon.llm.license_rules import BASE, GATE, RULES

#: Bytes that separate words, as a Java character class; letters are lower-cased for A-Z only.
_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPAN = "array<struct<b:int,ne:int,np:int,label:string,weight:double>>"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    weight: float
    keyword: str
    pattern: str


def rules() -> list[Rule]:
    """The base phrases and all rules, higher priorities first."""
    found = [Rule(label, 100, 1.0, phrase, phrase) for phrase, label in BASE] + [Rule(*r) for r in RULES]
    return sorted(found, key=lambda r: -r.priority)


def _spaces(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("bigint")


def _scan_sums(values: Column, join) -> Column:
    """Running sums (or maxima) of an array: each round joins every value with the one 2**k places before it."""
    turns = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int"))).otherwise(F.array().cast("array<int>"))

    def far(acc: Column, k: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i >= step, join(x, F.get(acc, i - step))).otherwise(x))

    return F.aggregate(turns, values, far)


def _found(words: Column, rule: Column) -> Column:
    """A rule's own fields with the lengths of what lies before its places and of the places, each text read once a rule."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
    lengths = lambda c: F.transform(c, lambda x: F.length(x))
    return F.struct(rule["label"].alias("label"), rule["priority"].alias("priority"), rule["weight"].alias("weight"), lengths(F.split(words, pattern, -1)).alias("before"), lengths(F.regexp_extract_all(words, pattern, F.lit(0))).alias("own"))


def _ended(found: Column) -> Column:
    """The same with the place where each match ends: a running sum, so n matches cost n log n."""
    steps = F.zip_with(F.slice(found["before"], 1, F.size(found["own"])), found["own"], lambda a, b: a + b)
    return F.struct(found["label"].alias("label"), found["priority"].alias("priority"), found["weight"].alias("weight"), found["own"].alias("own"), _scan_sums(steps, lambda a, b: a + b).alias("ends"))


def _spans(words: Column, rules: Column) -> Column:
    """Sorted-field structs of the places of all rules: start, minus end, minus priority, label, weight."""
    found = F.transform(F.filter(F.transform(rules, lambda r: _found(words, r)), lambda f: F.size(f["own"]) > 0), _ended)
    return F.flatten(F.transform(found, lambda f: F.zip_with(f["ends"], f["own"], lambda e, n: F.struct((e - n).alias("b"), (-e).alias("ne"), (-f["priority"]).alias("np"), f["label"].alias("label"), f["weight"].alias("weight")))))


_SPAN_OUT = "array<struct<label:string,weight:double,b:int,e:int>>"


def _outermost(spans: Column) -> Column:
    """The spans that lie in no other one: in order of start, longest first, those that end after all before them."""
    return F.transform(F.array(F.array_sort(spans)), lambda s: F.transform(F.array(_scan_sums(F.transform(s, lambda x: -x["ne"]), F.greatest)), lambda far: F.filter(s, lambda x, i: (i == 0) | (-x["ne"] > F.get(far, i - 1))))[0])[0]


def _resolve(spans: Column) -> Column:
    """The spans that lie in no other one and meet none of higher priority (or, at equal priority, of an earlier start).

    Most meet none of their two neighbours (ends ascend with starts) and stay; only the others are held against each other.
    """

    def free(acc: Column, s: Column) -> Column:
        span = F.struct(s["label"].alias("label"), s["weight"].alias("weight"), s["b"].alias("b"), s["e"].alias("e"))
        return F.when(F.exists(acc, lambda k: (k["b"] < s["e"]) & (s["b"] < k["e"])), acc).otherwise(F.concat(acc, F.array(span)))

    def chosen(alone: Column) -> Column:
        meets = lambda i: (F.coalesce(-F.get(alone, i - 1)["ne"] > F.get(alone, i)["b"], F.lit(False))) | (F.coalesce(F.get(alone, i + 1)["b"] < -F.get(alone, i)["ne"], F.lit(False)))
        marked = F.transform(alone, lambda s, i: F.struct(s["np"].alias("np"), s["b"].alias("b"), (-s["ne"]).alias("e"), s["label"].alias("label"), s["weight"].alias("weight"), meets(i).alias("met")))
        return F.transform(F.array(marked), _picked)[0]

    def _picked(marked: Column) -> Column:
        clear = F.transform(F.filter(marked, lambda s: ~s["met"]), lambda s: F.struct(s["np"].alias("np"), s["label"].alias("label"), s["weight"].alias("weight"), s["b"].alias("b"), s["e"].alias("e")))
        ranked = F.array_sort(F.filter(marked, lambda s: s["met"]))
        fought = F.aggregate(ranked, F.array().cast(_SPAN_OUT), free)
        return F.concat(F.transform(clear, lambda s: F.struct(s["label"].alias("label"), s["weight"].alias("weight"), s["b"].alias("b"), s["e"].alias("e"))), fought)

    by_place = F.transform(F.array(_outermost(spans)), chosen)[0]
    return F.transform(F.array_sort(F.transform(by_place, lambda s: F.struct(s["b"].alias("b"), s["e"].alias("e"), s["label"].alias("label"), s["weight"].alias("weight")))), lambda s: F.struct(s["label"].alias("label"), s["weight"].alias("weight"), s["b"].alias("b"), s["e"].alias("e"))).cast(_SPAN_OUT)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_words, n_base, first_word, last_word, base_labels, detections (label, weight, characters), labels, score.

    One row per input row, in place, without a shuffle, whatever the text's length.  Null and empty texts have no words, no
    labels and score 0; a null key stays null, repeated keys give repeated rows; further columns are ignored, whatever
    their names; an empty table gives no rows.  labels are those of the base phrases and of the detections, score is the greatest weight
    (1 with a base phrase).  Positions of detections are characters of the text's words joined by single blanks, a blank in front.
    """
    found = rules()
    # One literal each: hundreds of rules as expressions of their own would take longer to plan than most tables to scan.
    listed = [{"label": r.label, "priority": r.priority, "weight": r.weight, "keys": r.keyword.split("|"), "pattern": r.pattern} for r in found]
    table_of = F.from_json(F.lit(json.dumps(listed)), "array<struct<label:string,priority:int,weight:double,keys:array<string>,pattern:string>>")
    keys = F.split(F.lit("|".join(sorted({k for r in found for k in r.keyword.split("|")}))), r"\|")
    lower = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(docs[key].alias("_key"), F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, _BREAKS, " ")), F.lit(" ")).alias("_w"))
    gate = F.exists(F.split(F.lit("|".join(f" {g}" for g in GATE)), r"\|"), lambda g: F.contains(F.col("_w"), g))
    rows = rows.select("_key", F.when(F.col("_w") == "  ", F.lit(0).cast("bigint")).otherwise(_spaces(F.col("_w")) - 1).alias("_n"), F.when(gate, F.col("_w")).alias("_w"))
    rows = rows.withColumn("_keys", F.when(F.col("_w").isNotNull(), F.filter(keys, lambda k: F.contains(F.col("_w"), F.concat(F.lit(" "), k)))))
    w, starts, counts, labels = F.col("_w"), [], [], []
    for phrase, label in BASE:
        rx, size = F.lit(f"(?<= ){phrase}(?= )"), len(phrase.split())
        pieces = F.split(w, rx, -1)
        n = F.size(pieces) - 1
        first = _spaces(F.get(pieces, F.lit(0))) - 1
        last = F.col("_n") - _spaces(F.get(pieces, n)) + 1 - size
        counts.append(F.when(F.col("_w").isNotNull(), n).otherwise(0).cast("bigint"))
        starts.append((F.when(n > 0, first), F.when(n > 0, last)))
        labels.append(F.when(n > 0, F.lit(label)))
    spans = F.when(F.size("_keys") > 0, _spans(w, F.filter(table_of, lambda r: F.arrays_overlap(r["keys"], F.col("_keys"))))).otherwise(F.array().cast(_SPAN))
    none = F.array().cast(_SPAN_OUT)
    rows = rows.select(
        F.col("_key").alias(key),
        F.col("_n").alias("n_words"),
        sum(counts[1:], counts[0]).alias("n_base"),
        F.least(*[a for a, _ in starts]).cast("bigint").alias("first_word"),
        F.greatest(*[b for _, b in starts]).cast("bigint").alias("last_word"),
        F.when(w.isNotNull(), F.array_sort(F.array_compact(F.array(*labels)))).otherwise(F.array().cast("array<string>")).alias("_base"),
        F.when(w.isNotNull(), _resolve(spans)).otherwise(none).alias("detections"),
    )
    every = F.array_sort(F.array_distinct(F.concat("_base", F.transform("detections", lambda d: d["label"]))))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0))
    return rows.select(
        key, "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), "detections", F.array_join(every, ",").alias("labels"),
        F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("detections")
