"""Fill-in-the-middle texts by escaped marker injection, in SQL functions alone.

A delimiter of one byte is escaped where a text has it, and then put behind every unit of the
text (a line, with its line feed) by regexp_replace. How many units there are is how much
longer that made the text; any run of units is a substring_index by the delimiter's rank,
from the left or the right; and the parts, without delimiters and with the escapes undone, stand
in the order of the form that a hash of the id chooses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvion.llm.scratch import quoted

#: The delimiter, the escape, and what stands for each of them behind an escape.
MARK, ESCAPE, MARK_NAME, ESCAPE_NAME = "\x01", "\x02", "m", "e"
#: A unit: a line with its line feed, or a last one without. The loops give nothing back, which
#: changes no match, so a long line costs one walk.
UNIT = r"[^\n]*+\n|[^\n]++"
#: The markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + ESCAPE_NAME)), F.lit(MARK), F.lit(ESCAPE + MARK_NAME))


def _plain(marked: Column) -> Column:
    """A run of marked units as it stood in the text."""
    whole = F.replace(marked, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(whole, F.lit(ESCAPE + MARK_NAME), F.lit(MARK)), F.lit(ESCAPE + ESCAPE_NAME), F.lit(ESCAPE))


def _left(marked: Column, count: Column) -> Column:
    """The first ``count`` units, without the delimiter that ends them."""
    return F.call_function("substring_index", marked, F.lit(MARK), count.cast("int"))


def hashes(id_col: str, seed: int) -> list[Column]:
    """h1 to h4: the first four groups of eight hex digits of the sha256 of ``seed:id``, as numbers.
    A null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, percent: int = 100, spm_percent: int = 50, markers: Sequence[str] = MARKERS) -> DataFrame:
    """Cut each text into prefix, middle and suffix at two of the borders between its lines and
    put these in the order of a form: psm (prefix, suffix, middle), spm (suffix, prefix, middle),
    each behind its marker, or plain (the text).

    Returns id_col, n (units, long), form, output, prefix_chars, middle_chars (code points; null
    for plain). With n units the borders are h1 % (n + 1) and h2 % (n + 1), the smaller first; a
    text is transformed if h3 % 100 < ``percent``, and spm if h4 % 100 < ``spm_percent`` (see hashes).

    A null or empty text is plain, with no units and an empty output; so is a text that has a
    marker. A null id is hashed as an empty one. Repeated rows and ties pass through, one row out
    for each row in; rows of one id are cut by the same hashes. Other columns are not
    read, whatever their names. An empty table gives an empty result. A text of any length is
    cut whole, in some twenty times its memory.
    """
    prefix_mark, suffix_mark, middle_mark = markers
    text = F.coalesce(F.col("t"), F.lit(""))
    rows = df.select(F.col(quoted(id_col)).alias("i"), F.col(quoted(text_col)).cast("string").alias("t")).select("i", text.alias("t"), *(h.alias(f"h{k}") for k, h in enumerate(hashes("i", seed), 1)))
    rows = rows.withColumn("escaped", _escaped(F.col("t")))
    rows = rows.withColumn("marked", F.regexp_replace("escaped", F.lit(UNIT), F.lit("$0" + MARK)))
    rows = rows.withColumn("n", (F.octet_length("marked") - F.octet_length("escaped")).cast("long"))
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    marks = [F.contains(F.col("t"), F.lit(m)) for m in markers]
    plain = (F.col("n") == 0) | marks[0] | marks[1] | marks[2] | (F.col("h3") % 100 >= percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("i", "t", "marked", "n", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), form.alias("form"))
    rows = rows.withColumn("upto", _left(F.col("marked"), F.col("b")))
    # Behind the last unit stands a delimiter, so the suffix has one more of them than units.
    parts = {
        "prefix": _plain(_left(F.col("marked"), F.col("a"))),
        "middle": _plain(_left(F.col("upto"), F.col("a") - F.col("b"))),
        "suffix": _plain(_left(F.col("marked"), F.col("b") - F.col("n") - 1)),
    }
    cut = rows.select("i", "t", "n", "form", *(F.when(F.col("form") != "plain", c).alias(k) for k, c in parts.items()))
    first = F.when(F.col("form") == "psm", F.concat(F.lit(prefix_mark), "prefix", F.lit(suffix_mark), "suffix")).otherwise(F.concat(F.lit(suffix_mark), "suffix", F.lit(prefix_mark), "prefix"))
    output = F.when(F.col("form") == "plain", F.col("t")).otherwise(F.concat(first, F.lit(middle_mark), "middle"))
    return cut.select(F.col("i").alias(id_col), "n", "form", output.alias("output"), F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"))


def restored(output: str = "output", form: str = "form", markers: Sequence[str] = MARKERS) -> Column:
    """The text that an output of transform was made from: its markers occur once each, as
    texts that have one stay plain. Null for a null output or form."""
    prefix_mark, suffix_mark, middle_mark = markers
    middle = F.substring_index(output, middle_mark, -1)
    before = F.substring_index(output, middle_mark, 1)
    first = F.when(F.col(form) == "psm", F.lit(suffix_mark)).otherwise(F.lit(prefix_mark))
    opening = F.when(F.col(form) == "psm", F.lit(prefix_mark)).otherwise(F.lit(suffix_mark))
    left = F.call_function("substring", F.call_function("substring_index", before, first, F.lit(1)), F.length(opening) + 1)
    right = F.call_function("substring_index", before, first, F.lit(-1))
    moved = F.when(F.col(form) == "psm", F.concat(left, middle, right)).otherwise(F.concat(right, middle, left))
    return F.when(F.col(form).isNull(), F.lit(None).cast("string")).when(F.col(form) == "plain", F.col(output)).otherwise(moved)
