"""Personal data by candidate gradient boosting, in DataFrame operations only.

High-recall generators propose spans, which may overlap: the four base patterns, those
of their matches that fail the check of their kind, and looser forms (spelled-out
addresses, phone numbers without a plus). Boosted trees see the format of a span and
its context; a threshold per kind is the lowest score at which the accepted spans of a
held-out third of the base matches keep a precision of ``PRECISION``. Base spans always stay;
a proposed span is added if it passes and overlaps none of them.

The trees learn which base matches pass their check, from all of them, counted by features
and outcome; where these hold one outcome only, nothing is added. Positions are sums of the
lengths between and of the matches, code points throughout. Patterns are written with
possessive repeats, so that a run of any length takes no stack and no second try.

Defined results: null and empty texts have no spans; equal rows stay rows; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secondpass.llm.common import id_and_text
from secondpass.session import pin

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.99
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser forms of the same kinds.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}"
             r"(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z0-9-]{1,63}){1,8}",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
_KIND_SPAN = "array<struct<kind:string,start:int,end:int,s:string,before:string,after:string,ok:boolean>>"
_SPAN = "array<struct<start:int,end:int,s:string,before:string,after:string>>"
FEATURES = ("length", "digits", "marks", "letters", "groups", "plus", "at", "checked", "word_before", "cue", "word_after")
_CUES = r"(?i)(mail|contact|write|phone|call|tel|fax|mobile|card|visa|pay|ip|host|server|address)\W*$"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, pattern: str) -> Column:
    """Start, end, string and surroundings of all leftmost non-overlapping matches."""
    def placed(st: Column) -> Column:
        parts = F.transform(st["m"], lambda s, i: F.struct(
            F.length(F.get(st["g"], i)).alias("gap"), s.alias("s"),
            F.right(F.get(st["g"], i), F.lit(16)).alias("before"), F.left(F.get(st["g"], i + 1), F.lit(1)).alias("after")))
        start = F.struct(F.lit(0).alias("pos"), F.array().cast(_SPAN).alias("out"))

        def add(acc: Column, e: Column) -> Column:
            at = acc["pos"] + e["gap"]
            end = at + F.length(e["s"])
            one = F.struct(at.alias("start"), end.alias("end"), e["s"].alias("s"),
                           e["before"].alias("before"), e["after"].alias("after"))
            return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(parts, start, add, lambda acc: acc["out"])

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.split(text, pattern, -1).alias("g"))
    return _let(found, placed)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum of payment cards."""
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    value = F.aggregate(places, F.lit(0), lambda total, i: total + _let(
        F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
        lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return value % 10 == 0


def passes(kind: str, s: Column) -> Column:
    """Whether a match of the base pattern of its kind is a base span."""
    digits = F.regexp_replace(s, "[^0-9]", "")
    if kind == "ip":
        return s.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _proposals(text: Column, kind: str, pattern: str, of_base: bool) -> Column:
    """Matches with their kind; ``ok`` is the check of base matches and null for others."""
    return F.transform(matches(text, pattern), lambda x: F.struct(
        F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"),
        x["before"].alias("before"), x["after"].alias("after"),
        (passes(kind, x["s"]) if of_base else F.lit(None).cast("boolean")).alias("ok")))


def _number_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_no, doc_id, base spans and further proposals of every document; written once."""
    text, columns = F.col("text"), []
    for patterns, of_base in ((BASE, True), (LOOSE, False)):
        for kind, pattern in patterns.items():
            needed = {"email": "@", "phone": "+"}.get(kind) if of_base else None
            spans = _proposals(text, kind, pattern, of_base)
            columns.append(F.when(F.contains(text, F.lit(needed)), spans).otherwise(F.array().cast(_KIND_SPAN)) if needed else spans)
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.concat(*columns).alias("found"))
    # Numbers are given by the writer to written rows: the table is read back with them.
    return pin(rows.withColumn("row_no", F.monotonically_increasing_id()), "pii-candidates")


def _features(spans: DataFrame) -> DataFrame:
    count = lambda pattern: F.regexp_count("s", F.lit(pattern)).cast("double")
    return spans.select(
        "*", F.length("s").cast("double").alias("length"), count("[0-9]").alias("digits"),
        count(r"[\x20().-]").alias("marks"), count("[A-Za-z]").alias("letters"), count("[0-9]+").alias("groups"),
        F.startswith("s", F.lit("+")).cast("double").alias("plus"), F.contains("s", F.lit("@")).cast("double").alias("at"),
        F.when(F.col("kind") == "card", passes("card", F.col("s"))).when(F.col("kind") == "ip", passes("ip", F.col("s")))
        .otherwise(True).cast("double").alias("checked"),
        F.col("before").rlike(r"[A-Za-z0-9]$").cast("double").alias("word_before"),
        F.col("before").rlike(_CUES).cast("double").alias("cue"),
        F.coalesce(F.col("after").rlike("[A-Za-z0-9]"), F.lit(False)).cast("double").alias("word_after"),
    )


def fit(found: DataFrame):
    """Trees and thresholds per kind from every base match; None where one outcome is missing.

    Matches of equal features and outcome are counted, and the counts are their weights, so
    the rows to learn from stay few without leaving any match out.
    """
    spans = found.select("row_no", F.explode("found").alias("f")).select("f.*").where("ok IS NOT NULL")
    test = F.pmod(F.xxhash64("s"), F.lit(3)) == 0
    marked = _features(spans).withColumn("label", F.col("ok").cast("double")).withColumn("test", test)
    counted = marked.groupBy("kind", "label", "test", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("n"))
    counted = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(pin(counted, "pii-counted"))
    if counted.where("NOT test").select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=15, maxDepth=3, seed=7, weightCol="n").fit(counted.where("NOT test"))
    scored = model.transform(counted.where("test")).select("kind", "label", "n", vector_to_array("probability")[1].alias("p"))
    levels = scored.groupBy("kind", "p").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("right"))
    lower = Window.partitionBy("kind").orderBy(F.desc("p"))  # a row for every value the trees give
    kept = levels.withColumn("precision", F.sum("right").over(lower) / F.sum("n").over(lower)).where(F.col("precision") >= PRECISION)
    limits = {r["kind"]: r["p"] for r in kept.groupBy("kind").agg(F.min("p").alias("p")).collect()}
    return model, limits


def _printed(spans: Column) -> Column:
    order = F.array(*map(F.lit, KINDS))
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(
        F.array_position(order, x["kind"]).alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row."""
    found = candidates(docs, id_col, text_col)
    fitted = fit(found)
    slim = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    base = F.transform(F.filter("found", lambda x: F.coalesce(x["ok"], F.lit(False))), slim)
    rows = found.select("row_no", "doc_id", base.alias("base"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    if fitted is None:
        rows = rows.withColumn("added", none)
    else:
        model, limits = fitted
        more = found.select("row_no", base.alias("base"), F.explode(F.filter(
            "found", lambda x: ~F.coalesce(x["ok"], F.lit(False)))).alias("f"))
        more = more.where(~F.exists("base", lambda b: (b["start"] < F.col("f.end")) & (F.col("f.start") < b["end"])))
        more = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(_features(more.select("row_no", "f.*")))
        limit = F.lit(None).cast("double")
        for kind, value in limits.items():
            limit = F.when(F.col("kind") == kind, value).otherwise(limit)
        passed = model.transform(more).where(vector_to_array("probability")[1] >= limit)
        added = passed.groupBy("row_no").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
        rows = rows.join(added, "row_no", "left").withColumn("added", F.coalesce("added", none))
    return rows.select(
        "doc_id",
        *[_number_of("base", kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_printed(F.col("base")), 256).alias("base_sha256"),
        _printed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
