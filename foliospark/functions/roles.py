"""Why a sentence cites: rules in order, the first that fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rules, roles and cues; the sixth also needs a figure besides the marks.
RULES = (
    ("r1-review", "review", r"(?:reviewed in|for a (?:recent |comprehensive )?review,? see|(?:recent|comprehensive) review (?:of|by)|see .{0,30}for a review)"),
    ("r2-method", "method", r"(?:using the (?:method|protocol|procedure)s?\b|as (?:previously )?described (?:in|by)|(?:following|followed) the (?:protocol|procedure|method)|according to (?:the )?(?:method|protocol|procedure)|adapted from|as in ref\.?|(?:were|was) (?:performed|carried out|fitted|assessed|conducted) (?:as|with|using|in|at|following)|purchased from|force field|we used the)"),
    ("r3-data-source", "data-source", r"(?:data (?:for [^,.]{0,40})?(?:were |was )?(?:taken|obtained|retrieved|downloaded|drawn) from|datasets? (?:are |is |was |were )?(?:available|deposited|obtained|taken)|(?:training|test|validation) set (?:was |were )?(?:taken|drawn|obtained|curated)|sequences? (?:were |was )?(?:obtained|retrieved|taken) from|structures? (?:were |was )?(?:taken|retrieved|obtained) from|deposited (?:in|at)|PDB (?:entry|ID|code)|accession (?:number|code))"),
    ("r4-contrast", "contrast", r"(?:in contrast (?:to|with)|by contrast|unlike|contrary to|disagree(?:s|d|ment)?|inconsisten(?:t|cy) with|contradict(?:s|ed|ory)?|at odds with|fail(?:s|ed)? to reproduce|(?:could|was|were) not (?:be )?reproduced?|we did not observe|whereas .{0,40}reported|however,? .{0,40}reported)"),
    ("r5-support", "support", r"(?:consistent with|in (?:good |excellent |close )?agreement with|agrees? with|in line with|similar to (?:that|those) (?:reported|observed|found)|comparable to (?:the|that|those)|as (?:also )?(?:observed|reported|found|shown) (?:by|in)|reproduce[ds]? the .{0,40}(?:reported|observed) in|corroborat(?:e|es|ed|ing)|support(?:s|ing)? (?:the|our|this|these)|confirm(?:s|ing|ed)? (?:the|our|these))"),
    ("r6-comparison", "comparison", r"(?:compared (?:to|with)|in comparison (?:to|with)|exceed(?:s|ed|ing)?|outperform(?:s|ed|ing)?|higher than|lower than|greater than|less than|versus|\bvs\.?(?:\s|$)|relative to|-fold (?:higher|lower|improvement|increase)|than (?:that|those|the) reported)"),
    ("r7-motivation", "motivation", r"(?:remains? (?:a |an )?(?:major |significant |key )?(?:challenge|problem|bottleneck|limitation)|has (?:long )?been limited by|motivat(?:e|es|ed|ing|ion)|to address this|there is (?:a |an )?(?:growing |pressing )?(?:need|demand)|despite (?:considerable|significant|recent|much) (?:progress|advances|effort))"),
)
FIGURED, INTRODUCTORY = "r6-comparison", ("introduction", "background", "related-work")


def without_marks(sentence: Column) -> Column:
    """Without citation marks, numbered references, and words that end in figures, as names of things do."""
    x = F.regexp_replace(sentence, r"\[[0-9,;\s‐-―-]+\]", " ")
    x = F.regexp_replace(x, r"(?i)\bref\.?\s*\d+(?:\s*[,‐-―-]\s*\d+)*", " ")
    return F.regexp_replace(x, r"\b[A-Za-z][^\s.,;:)]*\d[^\s.,;:)]*", " ")


def role(sentence: Column, section: Column) -> Column:
    """struct(role, cue) of the first rule that fits; background for the rest of an introduction, else null."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("role"), F.lit("").alias("cue")))
    for cue, name, pattern in RULES:
        fits = sentence.rlike(f"(?i){pattern}")
        out = out.when(fits & without_marks(sentence).rlike(r"\d") if cue == FIGURED else fits, F.struct(F.lit(name).alias("role"), F.lit(cue).alias("cue")))
    return out.when(section.isin(*INTRODUCTORY), F.struct(F.lit("background").alias("role"), F.lit("r8-intro-default").alias("cue")))
