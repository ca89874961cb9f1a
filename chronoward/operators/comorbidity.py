"""Comorbidity categories and scores from diagnosis codes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: ICD-10 prefixes of the Charlson categories (published coding algorithm) and their weights; A-B is a range.
CHARLSON = {
    "myocardial_infarction": ("I21 I22 I252", 1),
    "heart_failure": ("I099 I110 I130 I132 I255 I420 I425-I429 I43 I50 P290", 1),
    "peripheral_vascular": ("I70 I71 I731 I738 I739 I771 I790 I792 K551 K558 K559 Z958 Z959", 1),
    "cerebrovascular": ("G45 G46 H340 I60-I69", 1),
    "dementia": ("F00-F03 F051 G30 G311", 1),
    "pulmonary": ("I278 I279 J40-J47 J60-J67 J684 J701 J703", 1),
    "rheumatic": ("M05 M06 M315 M32-M34 M351 M353 M360", 1),
    "peptic_ulcer": ("K25-K28", 1),
    "mild_liver": ("B18 K700-K703 K709 K713-K715 K717 K73 K74 K760 K762-K764 K768 K769 Z944", 1),
    "diabetes": ("E100 E101 E106 E108 E109 E110 E111 E116 E118 E119 E120 E121 E126 E128 E129 E130 E131 E136 E138 E139 E140 E141 E146 E148 E149", 1),
    "diabetes_complicated": ("E102-E105 E107 E112-E115 E117 E122-E125 E127 E132-E135 E137 E142-E145 E147", 2),
    "paralysis": ("G041 G114 G801 G802 G81 G82 G830-G834 G839", 2),
    "renal": ("I120 I131 N032-N037 N052-N057 N18 N19 N250 Z490-Z492 Z940 Z992", 2),
    "cancer": ("C00-C26 C30-C34 C37-C41 C43 C45-C58 C60-C76 C81-C85 C88 C90-C97", 2),
    "severe_liver": ("I850 I859 I864 I982 K704 K711 K721 K729 K765-K767", 3),
    "metastatic": ("C77-C80", 6),
    "aids": ("B20-B22 B24", 6),
}
#: The milder category does not count beside the more severe one.
HIERARCHY = (("mild_liver", "severe_liver"), ("diabetes", "diabetes_complicated"), ("cancer", "metastatic"))


def prefixes(text: str) -> list[str]:
    """Codes of a list with ranges: 'C77-C80' is C77, C78, C79, C80."""
    out = []
    for part in text.split():
        first, _, last = part.partition("-")
        if not last:
            out.append(first)
            continue
        letter, width = first[0], len(first) - 1
        out += [f"{letter}{n:0{width}d}" for n in range(int(first[1:]), int(last[1:]) + 1)]
    return out


def has_prefix(code: Column, codes: list[str]) -> Column:
    """Whether a code, whatever its case and with or without its point, begins with one of the prefixes."""
    return F.upper(F.replace(F.trim(code), F.lit("."))).rlike("^(" + "|".join(map(re.escape, codes)) + ")")


def charlson(diagnoses: DataFrame, by: str, code: str, hierarchy: bool = True) -> DataFrame:
    """0/1 for each category and the weighted cci_score of every entity with a diagnosis row."""
    flags = diagnoses.groupBy(by).agg(*[F.max(F.coalesce(has_prefix(F.col(code), prefixes(p)), F.lit(False)).cast("int")).alias(name) for name, (p, _) in CHARLSON.items()])
    if hierarchy:
        flags = flags.withColumns({mild: F.when(F.col(severe) == 1, 0).otherwise(F.col(mild)) for mild, severe in HIERARCHY})
    return flags.withColumn("cci_score", sum((F.col(name) * w for name, (_, w) in CHARLSON.items()), F.lit(0)))
