"""Text functions of the narrative analysis as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def prompt_sections(text: Column) -> tuple[Column, Column]:
    """(clues, reasoning) of a response with the three headings in order; empty strings otherwise."""
    form = r"(?s)\*\*CLUES:\*\*\s*(.*?)\s*\*\*REASONING:\*\*\s*(.*?)\s*\*\*OUTCOME:\*\*"
    part = lambda i: F.trim(F.coalesce(F.regexp_extract(text, form, i), F.lit("")))
    return part(1), part(2)


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda t: t != "")), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Lower-case ASCII words; everything else parts them."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z\s]", " "), r"\s+"), lambda t: t != "")


def keyword_pattern(keyword: str) -> str:
    """Whole-word pattern of a keyword of one or more words."""
    return r"\b" + r"\s+".join(re.escape(p) for p in keyword.lower().split()) + r"\b"


def _layers(keywords: list[str]) -> list[list[str]]:
    """Keywords parted so that none in a layer is the beginning of another: at each place a layer has one match at most."""
    layers: list[list[str]] = []
    for k in sorted(set(keywords)):
        fits = next((x for x in layers if not any(o.startswith(k) or k.startswith(o) for o in x)), None)
        if fits is None:
            layers.append([k])
        else:
            fits.append(k)
    return layers


def _factored(words: list[list[str]]) -> str:
    """One pattern of words given as lists of patterns, common beginnings written once."""
    heads: dict[str, list[list[str]]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    parts = [head + _factored(rests) for head, rests in heads.items()]
    if not parts:
        return ""
    whole = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
    return f"(?:{whole})?" if any(not w for w in words) else whole


def keyword_hits(low: Column, keywords: list[str]) -> Column:
    """Every keyword at every place where it stands in the lower-case text, single-spaced; one pass for each layer.

    The match looks ahead and takes nothing, so that keywords may overlap each other.
    """
    units = lambda k: [r"\s+" if c == " " else re.escape(c) for c in k]
    found = [F.regexp_extract_all(low, F.lit(rf"\b(?=({_factored(list(map(units, layer)))})\b)"), F.lit(1)) for layer in _layers([" ".join(k.lower().split()) for k in keywords])]
    return F.transform(F.concat(*found), lambda x: F.regexp_replace(x, r"\s+", " "))


def densities(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """``array<struct<family, value>>`` in the lexicon's order: keyword hits for each 100 words of two letters or more.

    Keywords count independently; blank text is 0. Hits and words are found once for all families: the one-element
    array binds them to a name.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.greatest(F.regexp_count(low, F.lit(r"\b[a-z]{2,}\b")), F.lit(1))
    bound = F.struct(keyword_hits(low, [k for ks in lexicon.values() for k in ks]).alias("hits"), words.alias("words"), (F.trim(low) == "").alias("blank"))

    def each(x: Column) -> Column:
        value = lambda ks: F.lit(100.0) * F.size(F.filter(x["hits"], lambda h: h.isin([" ".join(k.lower().split()) for k in ks]))) / x["words"]
        return F.array(*[F.struct(F.lit(f).alias("family"), F.when(x["blank"], 0.0).otherwise(value(ks)).alias("value")) for f, ks in lexicon.items()])

    return F.transform(F.array(bound), each)[0]


def density(text: Column, keywords: list[str]) -> Column:
    """The density of one family."""
    return densities(text, {"": keywords})[0]["value"]


def ngrams(tokens: Column, n: int) -> Column:
    last = F.size(tokens) - n
    starts = F.when(last >= 0, F.sequence(F.lit(1), last + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def fence_body(text: Column) -> Column:
    """Body of the first fenced block, else the text."""
    form = r"(?si)```(?:json)?\s*(.*?)\s*```"
    return F.when(text.rlike(form), F.trim(F.regexp_extract(text, form, 1))).otherwise(text)


def straight_quotes(text: Column) -> Column:
    return F.translate(text, "“”‘’ ", "\"\"'' ")


def without_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(text, r",\s*([}\]])", "$1")


def balanced(text: Column) -> Column:
    """The text with the square and then the curly brackets that it leaves open outside of strings."""
    bare = F.regexp_replace(text, r'"(?:\\.|[^"\\])*("|\\?$)', "")
    count = lambda c: F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit("")))
    missing = lambda a, b: F.greatest(count(a) - count(b), F.lit(0))
    return F.concat(text, F.repeat(F.lit("]"), missing("[", "]")), F.repeat(F.lit("}"), missing("{", "}")))


def client_json(text: Column) -> Column:
    """What follows a ```json mark up to the next fence, else the outermost braces; null where that isn't an object."""
    marked = F.substring_index(F.element_at(F.split(text, "```json", 2), -1), "```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    found = F.regexp_replace(F.when(F.contains(text, F.lit("```json")), marked).otherwise(braces), r"^\s+|\s+$", "")
    return F.when(F.try_parse_json(found).isNotNull() & found.startswith("{") & found.endswith("}"), found)
