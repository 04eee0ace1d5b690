"""Truth labels from marker columns: per row, per document set and per subject."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scores
from ..roles import DEFAULT, Roles


def _tokens(value: object) -> set[str]:
    return set(re.findall(r"[a-z0-9]+", str(value).strip().lower().replace("-", "_")))


def documents_of(sequence: object) -> tuple[str, ...]:
    """Documents whose markers count for a sequence: the table's, else what its words say."""
    name = str(sequence or "").strip().lower()
    if name in K.TRUTH_DOCUMENTS:
        return K.TRUTH_DOCUMENTS[name]
    words = _tokens(name)
    follows = bool(words & {"follow", "following"})
    found = ["preceding_clinic", "endoscopy", "histology"] + ["following_clinic"] * follows if {"all", "docs", "sequence"} <= words else []
    found += ["endoscopy"] * bool(words & {"endo", "endoscopy"}) + ["histology"] * bool(words & {"hist", "histo", "histology", "histopathology"})
    if "clinic" in words:
        found.append("following_clinic" if follows else "preceding_clinic")
    return tuple(dict.fromkeys(found))


def marker_score(column: str, document: str) -> int:
    """How well a column's name fits a document: matched words, and 10 more for a word that says label; -1 for none."""
    words = _tokens(column)
    bonus = 10 if words & K.LABEL_HINTS else 0
    whole = column.strip().lower()
    fits = [1 if len(a) == 1 and a[0] in whole else len(a) if words.issuperset(a) else -1 for a in K.MARKER_ALIASES[document]]
    best = max(fits)
    return best + bonus if best > 0 else -1


def resolve_markers(df: DataFrame, given: dict[str, str] | None = None) -> dict[str, str]:
    """Document -> marker column: as given, else the best-named column that says label and holds only 0, 1 and nulls.

    One aggregate looks at all candidates; of equally good names the first column counts.
    """
    if given:
        return {d: c for d, c in given.items() if c in df.columns}
    named = [c for c in df.columns if _tokens(c) & K.LABEL_HINTS and max(marker_score(c, d) for d in K.MARKER_ALIASES) > 0]
    if not named:
        return {}
    tests = [F.count_if(scores.coerce_marker(F.col(c)).isNotNull()).alias(c) for c in named]
    seen = df.agg(*tests).first().asDict()
    flags = [c for c in named if seen[c]]
    best = {d: max(flags, key=lambda c, d=d: marker_score(c, d), default=None) for d in K.MARKER_ALIASES}
    return {d: c for d, c in best.items() if c is not None and marker_score(c, d) >= 1}


def any_of(flags: list[Column], strict: bool = False) -> Column:
    """1 if a flag is 1, 0 if one is known (strict: all must be known), else null."""
    if not flags:
        return F.lit(None).cast("int")
    best = F.greatest(*flags) if len(flags) > 1 else flags[0]
    if not strict:
        return best
    known = F.forall(F.array(*flags), lambda x: x.isNotNull())
    return F.when(known, best)


def sequence_truth(sequence: Column, markers: dict[str, str], sets: dict[str, tuple[str, ...]], strict: bool = False) -> Column:
    """The OR over the documents of the row's sequence, by a map from sequences to places among the markers.

    The markers are read once for all sequences: the one-element array binds them to a name.
    """
    at = {d: i for i, d in enumerate(markers)}
    known = {s: [at[d] for d in ds if d in at] for s, ds in sets.items() if any(d in at for d in ds)}
    if not known:
        return F.lit(None).cast("double")
    table = F.create_map(*[x for s, places in known.items() for x in (F.lit(s), F.array(*map(F.lit, places)))])
    bound = F.struct(F.array(*[scores.coerce_marker(F.col(c)) for c in markers.values()]).alias("flags"), F.try_element_at(table, sequence).alias("at"))

    def either(x: Column) -> Column:
        shown = F.transform(x["at"], lambda i: F.get(x["flags"], i))
        return F.when(F.forall(shown, lambda v: v.isNotNull()), F.array_max(shown)) if strict else F.array_max(shown)

    return F.transform(F.array(bound), either)[0].cast("double")


def document_truth(df: DataFrame, roles: Roles = DEFAULT, markers: dict[str, str] | None = None, strict: bool = False, sequences: list[str] | None = None, into: str = "document_truth") -> DataFrame:
    """Rows with the label of their sequence; ``sequences`` names unknown ones to be read by their words."""
    table = K.TRUTH_DOCUMENTS | {s: documents_of(s) for s in sequences or ()}
    return df.withColumn(into, sequence_truth(F.lower(F.trim(roles.sequence)), resolve_markers(df, markers), table, strict))


def subject_truth(df: DataFrame, roles: Roles = DEFAULT, markers: dict[str, str] | None = None, into: str = "patient_truth") -> DataFrame:
    """Rows with the OR of all their subject's markers: a partial aggregate by subject, joined back."""
    flags = [scores.coerce_marker(F.col(c)) for c in resolve_markers(df, markers).values()]
    per = df.groupBy(F.col(roles.subject).alias("_subject")).agg(F.max(any_of(flags)).cast("double").alias(into))
    return df.join(per, F.col(roles.subject).eqNullSafe(F.col("_subject"))).drop("_subject")


def tier_truths(df: DataFrame, roles: Roles = DEFAULT, markers: dict[str, str] | None = None) -> DataFrame:
    """Rows with ``tier, document_truth, cumulative_truth``: one document's marker, or the OR over those shown."""
    flags = {d: c for d, c in (markers or K.FLAG_COLUMNS).items() if c in df.columns}
    single = {s: (d,) for s, d in K.SINGLE_DOCUMENT.items()}
    multi = {s: K.DOCUMENT_SETS[s] for s in K.MULTI_DOCUMENT}
    sequence = F.col(roles.sequence)
    return df.withColumns({"tier": scores.tier(sequence), "document_truth": sequence_truth(sequence, flags, single), "cumulative_truth": sequence_truth(sequence, flags, multi)})


def prepare_truth(df: DataFrame, mode: str = "patient", roles: Roles = DEFAULT, markers: dict[str, str] | None = None) -> tuple[DataFrame, str | None]:
    """(rows, truth column) of a truth mode: patient, document or document_complete; null where it has no labels."""
    if mode not in ("document", "document_complete"):
        from ..roles import truth_column

        return df, truth_column(df.columns)
    if not resolve_markers(df, markers):
        return df, None
    return document_truth(df, roles, markers, mode == "document_complete", into="_document_level_truth"), "_document_level_truth"
