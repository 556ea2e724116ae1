"""Fill-in-middle transformation in DataFrame functions only.

A unit grammar says between which neighbouring classes of characters one unit ends and the next begins. boundary() turns it
into a regex of lookarounds alone, so split() cuts without taking a character away: the pieces joined are the text. Two cut
points from a hash of the id make prefix, middle and suffix; the output holds them in an order with markers between, from
which restored() takes them back.

Null and empty texts have no units (split() would give one empty piece) and stay plain, as do texts that hold a marker. A
null id counts as an empty string in its hash. Repeated ids are cut at the same shares, so equal rows have equal results;
equal cut points leave the middle empty. Very long texts count whole: a row takes memory in proportion to its units, about
70 bytes each. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes of characters on either side of a boundary.
ANY, SPACE, NO_SPACE, STOP, LOWER, UPPER, DIGIT, NO_DIGIT = ".", r"[ \t-\r]", r"[^ \t-\r]", "[.!?]", r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"\P{Nd}"

#: Unit grammars: a boundary lies after the classes on the left and before those on the right.
UNITS: dict[str, list[tuple[str, str]]] = {
    "character": [(ANY, ANY)],
    "word": [(SPACE, NO_SPACE)],
    "line": [("\n", ANY)],
    "sentence": [(STOP + SPACE, NO_SPACE)],
    "subword": [(SPACE, NO_SPACE), (LOWER, UPPER), (NO_DIGIT, DIGIT), (DIGIT, NO_DIGIT)],
}

#: Fixed values of the output: markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = "<[PSM]>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


def boundary(grammar: list[tuple[str, str]]) -> str:
    """A regex of width zero that matches at the grammar's boundaries; "." stands for any character."""
    return "(?s)" + "|".join(f"(?<={left})(?={right})" for left, right in grammar)


def units(text: Column, unit: str = "character") -> Column:
    """The pieces of a text; none of an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(UNITS[unit]), -1))


def restored(output: Column, form: Column) -> Column:
    """The text out of an output and its form. Only plain texts hold a marker of their own, so three markers cut the others."""
    parts = F.split(output, MARKERS, -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == PLAIN, output).when(form == PSM, psm).otherwise(spm)


def transform(docs: DataFrame, unit: str = "character", seed: str = "1", rate: int = 90, spm_rate: int = 20, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, n (units of the text), form, prefix, middle, suffix (null where plain) and output.

    The first four 8-digit groups of the SHA-256 of "seed:id" choose: cut points by the first two, whether to transform
    (below `rate` per cent) by the third, the order (spm below `spm_rate` per cent) by the fourth.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring("_h", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    d = docs.select(*keep, digest.alias("_h"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    d = d.select(*keep, "_t", *(h.alias(f"_h{k}") for k, h in enumerate(drawn)), units(F.col("_t"), unit).alias("_u"))
    n = F.size("_u")
    plain = (n == 0) | F.col("_t").rlike(MARKERS) | (F.col("_h2") % 100 >= rate)
    form = F.when(plain, PLAIN).when(F.col("_h3") % 100 < spm_rate, SPM).otherwise(PSM)
    a, b = (F.col(h) % (n + 1) for h in ("_h0", "_h1"))
    d = d.select(*keep, "_t", "_u", n.cast("long").alias("n"), form.alias("form"), F.least(a, b).cast("int").alias("_a"), F.greatest(a, b).cast("int").alias("_b"))
    piece = lambda start, length: F.when(F.col("form") != PLAIN, F.array_join(F.slice("_u", start, length), ""))
    parts = {"prefix": piece(F.lit(1), F.col("_a")), "middle": piece(F.col("_a") + 1, F.col("_b") - F.col("_a")), "suffix": piece(F.col("_b") + 1, F.size("_u") - F.col("_b"))}
    d = d.select(*keep, "_t", "n", "form", *(v.alias(c) for c, v in parts.items()))
    psm, spm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"), F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == PLAIN, F.col("_t")).when(F.col("form") == PSM, psm).otherwise(spm)
    return d.select(*keep, "n", "form", *parts, output.alias("output"))
