"""Quantities in different units, converted to common ones.

Conversions are the edges of a graph, each an affine function (factor and offset, exact fractions).
``conversions`` composes the shortest path between any two units once, on the driver, and checks that
every cycle gives the identity; the composed table (a few dozen rows, whatever the data) is joined on
source unit and common unit. ``amounts`` reads the cells: the number, and the unit that the cell says,
else that the notes say of that field, else that the schema says for the review.

Null, empty and placeholder cells, amounts on other scales (scores that aren't shares, energy, steps,
operations) and amounts too large for a bigint give no row. A row_id given twice gives its rows twice; a
null row_id stays null. Very long cells are read whole. Empty tables give an empty result. Other columns
are ignored.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges of the unit graph: (from, to, factor, offset); to = from * factor + offset.
EDGES = [
    ("fraction", "percent", Fraction(100), Fraction(0)),
    ("permille", "percent", Fraction(1, 10), Fraction(0)),
    ("basis point", "percentage point", Fraction(1, 100), Fraction(0)),
    ("percentage point", "percent", Fraction(1), Fraction(0)),
    ("percent", "hundredth", Fraction(100), Fraction(0)),
    ("basis point", "hundredth", Fraction(1), Fraction(0)),
    ("second", "minute", Fraction(1, 60), Fraction(0)),
    ("minute", "hour", Fraction(1, 60), Fraction(0)),
    ("day", "hour", Fraction(24), Fraction(0)),
    ("week", "day", Fraction(7), Fraction(0)),
]
#: Unit in which an amount is counted, by field.
TARGETS = {"effect_size": "hundredth", "performance_improvement": "hundredth", "training_compute": "minute"}
#: Units of the fields that need no conversion.
COMMON = {"effect_size": ("percent", "percentage point"), "performance_improvement": ("percent", "percentage point"), "training_compute": ("hour",)}

Affine = tuple[Fraction, Fraction]
#: Digits of the numerators and denominators of conversions.
LARGEST = 12


def conversions(edges: list[tuple[str, str, Fraction, Fraction]] = EDGES) -> dict[tuple[str, str], Affine]:
    """(from, to) -> (factor, offset) over the fewest edges; ValueError if two ways disagree."""
    ways: dict[str, dict[str, Affine]] = {}
    for a, b, factor, offset in edges:
        ways.setdefault(a, {})[b] = (factor, offset)
        ways.setdefault(b, {})[a] = (1 / factor, -offset / factor)
    composed: dict[tuple[str, str], Affine] = {}
    for start in ways:
        composed[start, start] = (Fraction(1), Fraction(0))
        queue = deque([start])
        while queue:
            at = queue.popleft()
            factor, offset = composed[start, at]
            for to, (f, o) in ways[at].items():
                if (start, to) not in composed:
                    composed[start, to] = (factor * f, offset * f + o)
                    queue.append(to)
    # Decimals hold the parts of fractions up to this size; larger ones would be rounded in silence.
    if big := next((k for k, way in composed.items() if any(max(abs(x.numerator), x.denominator) >= 10**LARGEST for x in way)), None):
        raise ValueError(f"the conversion from {big[0]} to {big[1]} has more than {LARGEST} digits")
    # Each edge closes a cycle with the composed ways to its ends: both ways round must agree.
    for a, b, factor, offset in edges:
        for start in {s for s, t in composed if t == a}:
            f, o = composed[start, a]
            if composed[start, b] != (f * factor, o * factor + offset):
                raise ValueError(f"conversions from {start} to {b} disagree")
    return composed


def conversion_table(spark: SparkSession, edges: list[tuple[str, str, Fraction, Fraction]] = EDGES) -> DataFrame:
    """The composed conversions as (source, target, numerator, denominator, offset_numerator, offset_denominator)."""
    rows = [(a, b, f.numerator, f.denominator, o.numerator, o.denominator) for (a, b), (f, o) in sorted(conversions(edges).items())]
    return spark.createDataFrame(rows, "source string, target string, numerator bigint, denominator bigint, offset_numerator bigint, offset_denominator bigint")


# How units are spelled, most specific first (Java regular expressions, case-insensitive).
RATE_UNITS = [
    (r"hundredths? of (?:a|one) (?:percentage )?point|\bbasis points?\b|\bbps?\b|‱", "basis point"),
    (r"percentage points?|points? of percent|\bp\.?\s?p\b\.?|\bpp\b|\bpct\.? points?\b|(?:%|percent) points?", "percentage point"),
    (r"‰|\bper ?mill?e?\b|\bper thousand\b|\bper 1[, ]?000\b", "permille"),
    (r"\(?\b0\s?(?:-|–|to)\s?1\b\)?(?! ?00)|\bbetween 0 and 1\b|\bfraction\b|\bof (?:1|one)\b|\bshare\b|\bproportion\b", "fraction"),
    (r"%|\bper ?cent(?:age)?\b|\bpct\b|\(?\b0\s?(?:-|–|to)\s?100\b\)?", "percent"),
    (r"\bpoints?\b|\bpts?\b", "percentage point"),
]
OTHER_SCALES = r"(?i)\b(?:bleu|rouge\S*|chrf\S*|meteor|ppl|perplexity|rmse|mse|mae|wer|cer|smd|flops?|[kmg]?wh|[kmg]?joules?|steps?|iterations?|epochs?|tokens)\b|\b[dg]\s*=|\bcohen|\bhedges|standardi[sz]ed|\bsd\b|petaflop|flop/s"
TIME_UNITS = [(r"weeks?|wks?", "week"), (r"days?|d", "day"), (r"hours?|hrs?|h", "hour"), (r"minutes?|mins?", "minute"), (r"seconds?|secs?|s", "second")]
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen"]
DEVICES = r"(?:GPU|TPU|NPU|IPU|accelerator|device|chip|card|processor)(?:[ -]?cores?|[ -]?chips?)?s?"
FALLS = r"(?i)\b(?:down|drop(?:ped|s)?|fell|fall|decreased?|declined?|loss|lower|worse|reduced|minus)\b"
NOT_STATED = r"(?i)^\s*(?:not (?:specified|reported|stated|given|available)|n/?a|none|null|unknown|[-–—?.]*)\s*$"

_NUM = r"\d[\d.,'   ]*(?<=\d)(?:[eE][+-]?\d+)?"
_WORDS = "|".join(NUMBER_WORDS)


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _caught(text: Column, pattern: str, groups: list[int]) -> Column:
    """The numbered groups of the first match, found in one pass; null if there is no match. The text may not hold U+0001."""
    spread = F.regexp_replace(text, rf"(?s)\A(.*?)(?:{pattern})(.*)\z", "\x01".join(f"${n}" for n in groups))
    return F.when(F.instr(spread, "\x01") > 0, F.split(spread, "\x01"))


def plain_number(text: Column) -> Column:
    """A decimal out of a number's spelling: decimal comma or point, thousands set apart by comma,
    point, space or apostrophe; null if there is none. One separator followed by three digits sets
    thousands apart if it's a comma not behind a lone 0, otherwise it's the decimal mark."""

    def plain(bare: Column) -> Column:
        comma_last = F.instr(F.reverse(bare), ",") < F.instr(F.reverse(bare), ".")
        return (
            F.when(bare.contains(",") & bare.contains("."), F.when(comma_last, F.translate(F.translate(bare, ".", ""), ",", ".")).otherwise(F.translate(bare, ",", "")))
            .when(bare.rlike(r"^[1-9]\d{0,2}(,\d{3})+$"), F.translate(bare, ",", ""))
            .when(bare.contains(","), F.translate(bare, ",", "."))
            .when(bare.rlike(r"^[1-9]\d{0,2}(\.\d{3}){2,}$"), F.translate(bare, ".", ""))
            .otherwise(bare)
        ).try_cast("decimal(24,8)")

    return _let(F.translate(text, "' \u00a0\u202f", ""), plain)


def rate_unit(text: Column) -> Column:
    """The unit that a text names, null if none."""
    found = F
    for pattern, unit in RATE_UNITS:
        found = found.when(text.rlike(f"(?i){pattern}"), F.lit(unit))
    return F.when(text.rlike(r"\S"), found)


#: A term of a cell as it is stated: so many times a number of a unit; single: a number of hours of devices.
TERM = "array<struct<number:decimal(24,8),times:decimal(18,0),unit:string,single:boolean>>"


def _rate(text: Column, notes: Column, topic: Column, declared: Column) -> Column:
    """The amount of a rate as TERM, of one element or none: the first number outside of words; the text around it may
    name the unit, else the part of the notes on the field does, else the schema."""
    spread = F.when(text.contains("±") | text.contains("+"), F.regexp_replace(text, r"\s*(?:±|\+/-|\+-)\s*" + _NUM, "")).otherwise(text)
    first = rf"(?<![\p{{L}}\d.,])([+\-−–]?)\s*({_NUM})"
    said = F.get(F.filter(F.split(notes, ";"), lambda part: F.startswith(F.lower(F.ltrim(part)), topic)), F.lit(0))

    def term(cell: Column, caught: Column) -> Column:
        before, sign, number, after = (F.get(caught, F.lit(i)) for i in range(4))
        falls = sign.isin("-", "−", "–") | cell.rlike(FALLS)
        signed = plain_number(number) * F.when(falls, -1).otherwise(1).cast("decimal(1,0)")
        unit = F.coalesce(rate_unit(F.concat_ws(" ", before, after)), rate_unit(said), declared)
        return F.struct(signed.cast("decimal(24,8)").alias("number"), F.lit(1).cast("decimal(18,0)").alias("times"), unit.alias("unit"), F.lit(True).alias("single"))

    other = lambda cell: cell.rlike("[A-Za-z]") & cell.rlike(OTHER_SCALES)
    return _let(spread, lambda cell: F.when(~other(cell), _let(_caught(cell, first, [1, 2, 3, 4]), lambda caught: F.when(caught.isNotNull(), F.array(term(cell, caught))))))


def _times(text: Column) -> Column:
    """The terms of a training time as TERM."""
    unit = "|".join(p for p, _ in TIME_UNITS)
    amount = rf"(?:{_NUM}|\b(?:{_WORDS}|an?|single)\b)"
    span = rf"(?i)({amount})[\s-]*(?:(?:[A-Z][\w-]*\s+){{0,3}}?({DEVICES})[\s-]*)?(?<![\p{{L}}])({unit})(?![\p{{L}}/])"
    machines = rf"({amount})\s+(?:[A-Z][\w-]*\s+){{0,3}}?(?i:{DEVICES})(?![\p{{L}}])(?!\s*-?\s*(?i:{unit})(?![\p{{L}}]))"
    words = F.array(*map(F.lit, NUMBER_WORDS))
    spelled = lambda t: F.when(t.isin("a", "an", "single"), 1).otherwise(F.nullif(F.array_position(words, t), F.lit(0))).cast("decimal(24,8)")
    count = lambda t: _let(F.trim(t), lambda t: F.coalesce(plain_number(t), spelled(F.lower(t))))

    def named(t: Column) -> Column:
        found = F
        for pattern, name in TIME_UNITS:
            found = found.when(t.rlike(f"(?i)^(?:{pattern})$"), F.lit(name))
        return found

    def term(part: Column) -> Column:
        def read(caught: Column) -> Column:
            devices = _caught(part, machines, [2, 3])
            number, of_device, unit = (F.get(caught, F.lit(i)) for i in range(3))
            return _let(F.when(caught.isNotNull(), count(F.get(devices, F.lit(0)))), lambda many: F.struct(
                count(number).alias("number"), F.coalesce(many, F.lit(1)).cast("decimal(18,0)").alias("times"),
                named(unit).alias("unit"), ((of_device != "") & many.isNull()).alias("single"),
            ))

        # The first group of _caught's pattern is the text before: those of the span are 2, 3 and 4.
        return _let(_caught(part, span, [2, 3, 4]), read)

    parts = F.split(text, r"(?i)\s*;\s*(?:then\b)?\s*|\s+(?:then|plus|and)\s+|\s\+\s")
    return F.transform(F.filter(parts, lambda p: ~p.rlike(OTHER_SCALES)), term)


def _cells(matrix: DataFrame, schema: DataFrame) -> DataFrame:
    """(_cell, row_id, field, number, times, unit, single): the terms of every readable cell, out of one scan.

    _cell tells cells apart, those of repeated and null row_ids too.
    """
    rates = {"effect_size": "effect size", "performance_improvement": "improvement"}
    declared = schema.where(F.col("key").isin(*rates)).groupBy("review").agg(*(F.min(F.when(F.col("key") == f, F.col("description"))).alias(f"_{f}") for f in rates))
    # The schema's units are read once per review, not per cell.
    declared = declared.select("review", *(rate_unit(F.col(f"_{f}")).alias(f"_{f}") for f in rates))
    clean = lambda f: F.translate(f, "\x01", " ").alias("text")
    cells = [F.struct(F.lit(f).alias("field"), clean(f), F.lit(rates.get(f)).cast("string").alias("topic"), (F.col(f"_{f}") if f in rates else F.lit(None)).cast("string").alias("declared")) for f in TARGETS]
    stated = matrix.join(declared, "review", "left").select("row_id", "notes", F.explode(F.filter(F.array(*cells), lambda c: c["text"].rlike(r"\w"))).alias("c"))
    terms = F.when(F.col("c.field") == "training_compute", _times(F.col("c.text")).cast(TERM)).otherwise(_rate(F.col("c.text"), F.col("notes"), F.col("c.topic"), F.col("c.declared")).cast(TERM))
    readable = F.filter(terms, lambda t: t["number"].isNotNull() & t["unit"].isNotNull())
    numbered = stated.select(F.monotonically_increasing_id().alias("_cell"), "row_id", F.col("c.field").alias("field"), readable.alias("terms"))
    return numbered.select("_cell", "row_id", "field", F.explode("terms").alias("t")).select("_cell", "row_id", "field", "t.*")


def amounts(matrix: DataFrame, schema: DataFrame) -> DataFrame:
    """Every readable amount in common units: row_id, field, amount (integer), common (stated so already).

    amount counts hundredths of a percent or of a point, and accelerator-minutes; halves round up, away
    from zero. Terms of training time are added up.
    """
    terms = _cells(matrix.select("row_id", "review", "notes", *TARGETS), schema.select("review", "key", "description"))
    return _converted(terms, conversion_table(matrix.sparkSession), TARGETS)


def _converted(terms: DataFrame, table: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Terms joined on their unit and their field's target, converted (factor and offset, then times) and added up by cell."""
    target = F.create_map(*(F.lit(x) for pair in targets.items() for x in pair))[F.col("field")]
    table = table.where(F.col("target").isin(*set(targets.values()))).withColumnRenamed("source", "unit")
    # The table has a row per pair of units: its size is that of EDGES, so it's safe to send to all.
    joined = terms.withColumn("target", target).join(F.broadcast(table), ["unit", "target"])
    whole = lambda c: F.col(c).cast(f"decimal({LARGEST},0)")
    scaled = F.try_divide(F.try_multiply(F.col("number"), whole("numerator")), whole("denominator"))
    offset = whole("offset_numerator") / whole("offset_denominator")
    part = F.try_multiply(F.try_add(scaled, offset).try_cast("decimal(38,10)"), F.col("times")).try_cast("decimal(38,10)")
    common = F.when(F.col("field") == "training_compute", F.col("single") & F.col("unit").isin(*COMMON["training_compute"])).otherwise(F.col("unit").isin(*COMMON["effect_size"]))
    # The terms of a cell lie in one partition: they are added up before the shuffle.
    summed = joined.select("_cell", "row_id", "field", part.alias("part"), common.alias("common")).groupBy("_cell", "row_id", "field").agg(
        F.sum("part").alias("sum"), F.count("part").alias("read"), F.count("*").alias("terms"), F.bool_and("common").alias("common"),
    )
    amount = F.when(F.col("read") == F.col("terms"), F.round("sum", 0).try_cast("bigint"))
    return summed.select("row_id", "field", amount.alias("amount"), (F.col("common") & (F.col("terms") == 1)).alias("common")).where("amount is not null")


def restated(matrix: DataFrame, schema: DataFrame) -> DataFrame:
    """The cells that state an amount in another unit than the common one: row_id, field, amount."""
    return amounts(matrix, schema).where("not common").select("row_id", "field", "amount")
