"""Column functions over text: templates, prompts, answer extraction, clean-up."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpuslab.operators.lookup import strip




# --- templates -------------------------------------------------------------

def _or_empty(df: DataFrame, *names: str) -> Column:
    for name in names:
        if name in df.columns:
            return F.col(name)
    return F.lit("")


def qa_text(df: DataFrame) -> Column:
    """``text`` if the table has it, else question and answer under ``Q:``/``A:``."""
    if "text" in df.columns:
        return F.col("text")
    return F.concat(
        F.lit("Q:\n"), _or_empty(df, "question"), F.lit("\n\nA:\n"), _or_empty(df, "answer")
    )


def code_text(df: DataFrame) -> Column:
    """``text`` if the table has it, else prompt and ``code`` (or ``solution``)."""
    if "text" in df.columns:
        return F.col("text")
    return F.concat(
        F.lit("# Prompt\n"), _or_empty(df, "prompt"),
        F.lit("\n\n# Solution\n"), _or_empty(df, "code", "solution"),
    )


# --- prompts ---------------------------------------------------------------

def labels(choices: Column, cap: int | None = None) -> Column:
    """``[A, B, C, …]``, one per choice, at most ``cap``; empty for no choices."""
    n = F.size(choices) if cap is None else F.least(F.size(choices), F.lit(cap))
    return F.when(
        n > 0,
        F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.char(i + 65)),
    ).otherwise(F.array().cast("array<string>"))


def _lettered(choices: Column) -> Column:
    return F.transform(choices, lambda c, i: F.concat(F.char(i + 65), F.lit(". "), c))


def mcq_prompt(question: Column, choices: Column, style: str = "en") -> Column:
    """Multiple-choice prompt: ``en`` and ``tr`` differ in the cue, ``full`` in both ends."""
    body = F.concat_ws("\n", _lettered(choices))
    if style in ("en", "tr"):
        cue = {"en": "Answer:", "tr": "Cevap:"}[style]
        return F.concat(question, F.lit("\n"), body, F.lit("\n" + cue))
    if style == "full":
        return F.concat(F.lit("Question: "), question, F.lit("\n"), body, F.lit("\nAnswer: "))
    raise ValueError(f"unknown prompt style {style}")


def numeric_prompt(question: Column, style: str = "en") -> Column:
    """Prompt for a numeric answer: ``en``, ``question`` (labelled) or ``tr``."""
    if style == "en":
        return F.concat(strip(question), F.lit("\nAnswer:"))
    if style == "question":
        return F.concat(F.lit("Question: "), strip(question), F.lit("\nAnswer:"))
    if style == "tr":
        return F.concat(F.lit("Soru: "), question, F.lit("\n\nÇözüm:"))
    raise ValueError(f"unknown prompt style {style}")


def ending_context(ctx_a: Column, ctx_b: Column, style: str = "spaced") -> Column:
    """Context of an ending-choice item; ``joined`` glues the halves without a space."""
    a, b = F.coalesce(ctx_a, F.lit("")), F.coalesce(ctx_b, F.lit(""))
    if style == "joined":
        return F.concat(a, b)
    return F.concat(strip(F.concat(a, F.lit(" "), b)), F.lit(" "))


# --- answers ---------------------------------------------------------------

# The number formats and cue words answers are written with.
SIGNED = r"-?\d+(?:\.\d+)?"
DECIMAL = r"[+-]?\d*\.?\d+"
CUES = (
    rf"cevap[:\s]*({DECIMAL})",
    rf"sonuç[:\s]*({DECIMAL})",
    rf"toplam[:\s]*({DECIMAL})",
    rf"=\s*({DECIMAL})",
    rf"({DECIMAL})\s*TL",
    rf"({DECIMAL})\s*lira",
    rf"({DECIMAL})\s*kilogram",
    rf"({DECIMAL})\s*metre",
    rf"({DECIMAL})\s*saat",
    rf"({DECIMAL})\s*dakika",
)


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, f"(?U){pattern}", 1), F.lit(""))


def _last(text: Column, pattern: str, flags: str = "(?U)") -> Column:
    found = F.regexp_extract_all(text, F.lit(f"{flags}{pattern}"), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


def parse_gold(answer: Column) -> Column:
    """Gold index from a letter A–E, a digit string or an int; NULL when it is neither."""
    token = F.upper(strip(answer.cast("string")))
    return F.when(token.rlike("^[A-E]$"), F.ascii(token) - 65).otherwise(
        F.when(token.rlike(r"^[+-]?\d+$"), token.try_cast("int"))
    )


def _plain(text: Column, strip_commas: bool) -> Column:
    return F.regexp_replace(text, r"(?<=\d),(?=\d{3})", "") if strip_commas else text


def last_number(text: Column, strip_commas: bool = False) -> Column:
    """The last number as written, NULL without one.

    A thousands separator splits a number (``1,234`` gives ``234``), which
    published scores rely on; ``strip_commas`` reads it as one number.
    """
    return _last(_plain(text, strip_commas), f"({SIGNED})")


def extract_number(text: Column, strip_commas: bool = False) -> Column:
    """The number after the first ``####`` marker, else the last number."""
    plain = _plain(text, strip_commas)
    return F.coalesce(_first(plain, rf"####\s*({SIGNED})"), _last(plain, f"({SIGNED})"))


def _marked_number(text: Column) -> Column:
    return _first(text, rf"####\s*({DECIMAL})").try_cast("double")


def gold_number(text: Column) -> Column:
    """The marked number, else the last number, as a double."""
    return F.coalesce(_marked_number(text), _last(text, f"({DECIMAL})").try_cast("double"))


def cue_number(text: Column, cues: Sequence[str] = CUES) -> Column:
    """The marked number, else the last hit of the first cue that hits, else the last number."""
    hits = [_last(text, cue, "(?iuU)").try_cast("double") for cue in cues]
    return F.coalesce(_marked_number(text), *hits, _last(text, f"({DECIMAL})").try_cast("double"))


def answers_match(pred: Column, gold: Column, mode: str = "text") -> Column:
    """``text``: equal after trimming, NULL is wrong. ``number``: within 1e-6, a NULL
    prediction counts as 0."""
    if mode == "text":
        return F.coalesce(strip(pred) == strip(gold), F.lit(False))
    if mode == "number":
        return F.abs(F.coalesce(pred, F.lit(0.0)) - gold) < 1e-6
    raise ValueError(f"unknown mode {mode}")


# --- generated text --------------------------------------------------------

# Where a code completion ends.
CODE_STOPS = (
    '\nif __name__ == "__main__":',
    "\nif __name__ == '__main__':",
    "\nclass ",
    "\n# End",
    "\n\n\n",
)


def cut_at(text: Column, stops: Sequence[str] = CODE_STOPS) -> Column:
    """Text before the earliest of the stop strings."""
    ends = [F.nullif(F.instr(text, s), F.lit(0)) for s in stops]
    end = F.least(*ends, F.length(text) + 1)
    return F.substring(text, F.lit(1), end - 1)


def strip_echo(text: Column, prompt: Column, trim: bool = True) -> Column:
    """Drop the prompt if the text repeats it first, then trim."""
    rest = F.when(
        F.startswith(text, prompt), F.substring(text, F.length(prompt) + 1, F.length(text))
    ).otherwise(text)
    return strip(rest) if trim else rest


def preview(text: Column, n: int = 200) -> Column:
    """First ``n`` characters, ``...`` appended if there were more."""
    return F.when(
        F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))
    ).otherwise(text)


# --- names and numbers -----------------------------------------------------

def model_to_dir(model: Column) -> Column:
    return F.replace(model, F.lit("/"), F.lit("__"))


def dir_to_model(name: Column) -> Column:
    return F.replace(name, F.lit("__"), F.lit("/"))


def lang_head(tag: Column) -> Column:
    """``eng`` of ``eng-Latn``."""
    return F.split_part(tag, F.lit("-"), F.lit(1))


def fmt(value: Column, digits: int = 3, thousands: bool = False) -> Column:
    """Number label; halves round up in Spark where Python rounds the binary value."""
    if thousands:
        return F.format_number(value, digits)
    return F.format_string(f"%.{digits}f", value.cast("double"))


# --- normalisers -----------------------------------------------------------

def _decomposed(text: Column, form: str) -> Column:
    """Unicode decomposition, which has no SQL function; texts travel in Arrow batches."""
    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pc.utf8_normalize(texts, form)

    return run(text)


def normalize_text(text: Column, style: str = "sequence") -> Column:
    """``sequence``: quote marks, NFKD, accents off, runs of blanks to one.

    ``bert``: control characters out, white space to blanks, ideographs set apart,
    accents off, lower case.
    """
    if style == "sequence":
        quoted = F.replace(F.replace(text, F.lit("``"), F.lit('"')), F.lit("''"), F.lit('"'))
        bare = F.regexp_replace(_decomposed(quoted, "NFKD"), r"\p{Mn}+", "")
        return F.regexp_replace(bare, " {2,}", " ")
    if style == "bert":
        blank = F.regexp_replace(text, r"[\t\n\r\p{Zs}]", " ")
        clean = F.regexp_replace(blank, "[\\p{Cc}\\p{Cf}\\p{Co}\\p{Cn}\ufffd]", "")
        spaced = F.regexp_replace(clean, r"([\p{IsHan}&&[^\p{IsCommon}]])", " $1 ")
        return F.lower(F.regexp_replace(_decomposed(spaced, "NFD"), r"\p{Mn}+", ""))
    raise ValueError(f"unknown style {style}")
