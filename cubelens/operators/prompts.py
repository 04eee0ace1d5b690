"""Experiments, prompt sections and token budgets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_count

REMINDER = "Return a single JSON object and nothing else."
MISSING, CUT = "NOT_AVAILABLE", "[TRUNCATED]"

# What a sequence may ask for, the document columns that it shows, and under which heading.
_REPORT, _SCOPE, _BEFORE, _AFTER = "result_report", "Combined_Content", "preceding_clinic_letter", "following_clinic_letter"
SECTIONS = {
    "HISTOPATHOLOGY REPORT": [("HISTOPATHOLOGY REPORT", _REPORT)],
    "PRIMARY REPORT": [("HISTOPATHOLOGY REPORT", _REPORT)],
    "ENDOSCOPY REPORT": [("ENDOSCOPY REPORT", _SCOPE)],
    "SECONDARY REPORT": [("ENDOSCOPY REPORT", _SCOPE)],
    "PRECEDING CLINIC LETTER": [("PRECEDING CLINIC LETTER", _BEFORE)],
    "PRECEDING CONTEXT NOTE": [("PRECEDING CLINIC LETTER", _BEFORE)],
    "FOLLOWING CLINIC LETTER": [("FOLLOWING CLINIC LETTER", _AFTER)],
    "FOLLOWING CONTEXT NOTE": [("FOLLOWING CLINIC LETTER", _AFTER)],
    "BOTH CLINIC LETTERS": [("PRECEDING CLINIC LETTER", _BEFORE), ("FOLLOWING CLINIC LETTER", _AFTER)],
    "CLINIC LETTERS": [("PRECEDING CLINIC LETTER", _BEFORE), ("FOLLOWING CLINIC LETTER", _AFTER)],
}
BARE = ("CLINIC LETTER", "CONTEXT NOTE")


def timing(sequence: Column) -> Column:
    """Which context notes a sequence's name asks for."""
    after = F.contains(sequence, F.lit("following"))
    return F.when(after & F.contains(sequence, F.lit("preceding")), "both").when(after, "following").otherwise("preceding")


def experiments(spark: SparkSession, templates: dict[str, str], sequences: dict[str, Sequence[str]]) -> DataFrame:
    """Templates crossed with sequences: a configuration's size, not the data's."""
    t = spark.createDataFrame(list(templates.items()), "prompt_name string, prompt_content string")
    s = spark.createDataFrame([(k, list(v)) for k, v in sequences.items()], "report_sequence_name string, report_sequence array<string>")
    both = t.crossJoin(F.broadcast(s))
    name = F.concat("prompt_name", F.lit("_shot_"), "report_sequence_name")
    return both.select(name.alias("experiment_name"), "prompt_name", "prompt_content", "report_sequence_name", "report_sequence", timing(F.col("report_sequence_name")).alias("context_note_timing"))


def sections(sequence: Column, when: Column) -> Column:
    """``array<struct<label, text>>`` of the documents that a sequence asks for, in its order; blank ones say so."""
    body = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.col(c)).otherwise(MISSING)
    one = lambda label, c: F.struct(F.lit(label).alias("label"), body(c).alias("text"))
    none = F.array().cast("array<struct<label:string,text:string>>")

    def asked(entry: Column) -> Column:
        cases = [F.when(entry == k, F.array(*[one(label, c) for label, c in parts])) for k, parts in SECTIONS.items()]
        both = F.array(one("PRECEDING CLINIC LETTER", _BEFORE), one("FOLLOWING CLINIC LETTER", _AFTER))
        bare = F.when(when == "both", both).when(when == "following", F.array(one("CLINIC LETTER", _AFTER))).otherwise(F.array(one("CLINIC LETTER", _BEFORE)))
        return F.coalesce(*cases, F.when(entry.isin(*BARE), bare), none)

    return F.flatten(F.transform(sequence, asked))


def rendered(parts: Column) -> Column:
    """The sections as text, a bold heading over each."""
    return F.trim(F.array_join(F.transform(parts, lambda s: F.concat(F.lit("**"), s["label"], F.lit("**:\n\n"), s["text"], F.lit("\n"))), "\n"))


def message(template: Column, reports: Column) -> Column:
    return F.concat(F.lit("\n"), template, F.lit("\n\n**INPUT:**\n\n"), reports, F.lit(f"\n\n{REMINDER}\n"))


def truncate_words(text: Column, limit: int) -> tuple[Column, Column]:
    """(the first ``limit`` words, whether any went)."""
    words = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return F.when(F.size(words) > limit, F.array_join(F.slice(words, 1, limit), " ")).otherwise(text), token_count(text) > limit


class Words:
    """White-space tokens: the default where no model tokenizer is at hand."""

    def encode(self, text: str) -> list[str]:
        import re

        return re.findall(r"\s*\S+", text)

    def decode(self, tokens: list[str]) -> str:
        return "".join(tokens)


class TokenizerFile:
    """The tokens of a model's ``tokenizer.json``, wherever it lies; needs the tokenizers library on the executors."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def decode(self, tokens: list[int]) -> str:
        return self.model.decode(tokens, skip_special_tokens=False)


def fit(template: str, parts: Sequence[tuple[str, str]], tokenizer: object, limit: int) -> tuple[str, bool, list[str]]:
    """(message, whether anything was cut, headings of cut sections) within ``limit`` tokens.

    Sections share what the frame leaves; one that needs less than an even share leaves the rest to those after it, one
    that needs more is cut to its share. If the frame alone is too long the whole message is cut.
    """
    size = lambda text: len(tokenizer.encode(text))
    head, tail = f"{template}\n\n**INPUT:**\n\n", f"\n\n{REMINDER}\n"
    clip = lambda text, n: tokenizer.decode(tokenizer.encode(text)[:n])
    room = limit - size(head) - size(tail)
    if room <= 0:
        text = head + "\n".join(f"**{k}**:\n\n{v}\n" for k, v in parts) + tail
        return (text, False, []) if size(text) <= limit else (clip(text, limit), True, [k for k, _ in parts])
    made, cut = [], []
    for i, (label, body) in enumerate(parts):
        share = max(0, room) // (len(parts) - i) - size(f"**{label}**:\n\n") - size("\n")
        if size(body) > max(0, share):
            body = (clip(body, share) if share > 0 else "") or CUT
            cut.append(label)
        made.append(f"**{label}**:\n\n{body}\n")
        room -= size(made[-1])
    text = head + "".join(made) + tail
    over = size(text) > limit
    return clip(text, limit) if over else text, bool(cut) or over, cut


def budgeted(tokenizer: Callable[[], object] = Words, limit: int = 4000) -> Callable[[Column, Column], Column]:
    """Arrow function of (template, sections) -> struct of the message, whether it was cut and which sections were."""

    @F.pandas_udf("message string, truncated boolean, truncated_sections array<string>")
    def run(template: pd.Series, parts: pd.Series) -> pd.DataFrame:
        tokens = tokenizer()
        rows = [fit(t, [(s["label"], s["text"]) for s in p], tokens, limit) for t, p in zip(template, parts, strict=True)]
        return pd.DataFrame(rows, columns=["message", "truncated", "truncated_sections"])

    return run
