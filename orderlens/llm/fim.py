"""Operator 11: fill-in-the-middle rows by a regular expression with counted quantifiers, in DataFrame functions.

A text is read as units from its start, each matched where the last one ended. regexp_count gives their number n, two draws give the
ends a <= b of prefix and middle, and a pattern of the row's own, `^((?:unit){a}+)((?:unit){b-a}+)(.*)$`, captures prefix, middle and
suffix in one match. The quantifiers are possessive, so the match is a loop over units that never steps back: time grows with the text
and no stack with its length. The replacement of that match writes the three parts in their new order, with marks before them; a
second pattern finds the marks and puts the parts back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Units: code points, words with the white space before them, lines with their ends. None may match nothing.
CHARACTER, WORD, LINE = "(?s:.)", r"(?:\s*\S+)", r"(?:[^\n]*\n|[^\n]+)"

#: Units counted as one block first, so that a long text makes no array of all its units.
BLOCK = 256


@dataclass(frozen=True)
class Plan:
    """Marks before prefix, suffix and middle (none within another), the share of texts that are cut, the share of those with the suffix first, and what draws begin with."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    cut_percent: int = 90
    suffix_first_percent: int = 20
    seed: str = "1"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(doc_id: Column, seed: str) -> list[Column]:
    """Four numbers under 2^32: the first groups of 8 hex digits of the sha256 of seed, a colon and doc_id in decimal (null: nothing)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def n_units(text: Column, unit: str) -> Column:
    """Units that follow each other from the start of text: whole blocks of them, then those of the rest."""
    block = f"(?:{unit}){{{BLOCK}}}+"
    rest = F.regexp_replace(text, F.lit(f"^(?:{block})*+"), F.lit(""))
    return (F.regexp_count(text, F.lit(rf"\G{block}")) * BLOCK + F.regexp_count(rest, F.lit(rf"\G{unit}"))).cast("long")


def _quoted(mark: str) -> str:
    return r"\Q" + mark + r"\E"


def _plain(mark: str) -> str:
    """mark as a replacement has it."""
    return mark.replace("\\", "\\\\").replace("$", "\\$")


def cut_text(text: Column, a: Column, b: Column, form: Column, unit: str, plan: Plan) -> Column:
    """text as form says: `psm` prefix, suffix, middle; `spm` suffix, prefix, middle, each with its mark before it; `plain` as it is."""
    pattern = F.concat(F.lit(f"(?s)^((?:{unit}){{"), a.cast("string"), F.lit(f"}}+)((?:{unit}){{"), (b - a).cast("string"), F.lit("}+)(.*)$"))
    p, s, m = map(_plain, plan.marks)
    order = F.when(form == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    return F.when(form == "plain", text).otherwise(F.regexp_replace(text, pattern, order))


def restore_text(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The text that cut_text was given. No part holds a mark, so each mark is the first of its kind."""
    p, s, m = map(_quoted, plan.marks)
    psm = F.regexp_replace(output, F.lit(f"(?s)^{p}(.*?){s}(.*?){m}(.*)$"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(f"(?s)^{s}(.*?){p}(.*?){m}(.*)$"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(docs: DataFrame, unit: str = CHARACTER, plan: Plan = Plan()) -> DataFrame:
    """One row per row of docs: doc_id, n (units), form, prefix_units, middle_units (null if plain), output.

    A null text counts as empty. Form is plain for texts without units, for those that hold a mark, and for 100 - cut_percent of the
    rest. What stands after the last unit (white space after the last word) is part of the suffix. Rows of one doc_id are drawn
    alike, a null doc_id has draws of its own; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    if any(x in y for x in plan.marks for y in plan.marks if x is not y) or len({*plan.marks}) < 3:
        raise ValueError("no mark may stand within another")
    h = [f"_h{i}" for i in range(4)]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("_text"), *(x.alias(n) for x, n in zip(draws(F.col("doc_id"), plan.seed), h)))
    rows = rows.withColumn("n", n_units(F.col("_text"), unit))
    ends = [F.pmod(F.col(x), F.col("n") + 1) for x in h[:2]]
    marked = F.lit(False)
    for mark in plan.marks:
        marked = marked | F.contains("_text", F.lit(mark))
    plain = (F.col("n") == 0) | marked | (F.pmod(h[2], F.lit(100)) >= plan.cut_percent)
    form = F.when(plain, "plain").when(F.pmod(h[3], F.lit(100)) < plan.suffix_first_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "n", "_text", form.alias("form"), F.least(*ends).alias("_a"), F.greatest(*ends).alias("_b"))
    a, b, form = F.col("_a"), F.col("_b"), F.col("form")
    inside = lambda x: F.when(form != "plain", x)
    return rows.select("doc_id", "n", "form", inside(a).alias("prefix_units"), inside(b - a).alias("middle_units"), cut_text(F.col("_text"), a, b, form, unit, plan).alias("output"))


def restore(cut: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, text) of rows with doc_id, form and output."""
    return cut.select("doc_id", restore_text(F.col("output"), F.col("form"), plan).alias("text"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256 FROM p
"""
