"""Vocabularies that tell statistics, tables and designs apart; all for lower-cased text.

Words are kept in alphabetical lists. A vocabulary is turned into one
alternation with its longest members first, as alternations take the first
branch that matches.
"""

from __future__ import annotations

PLUS_MINUS_SIGNS = "±∓"


def _words(text: str) -> list[str]:
    return [w.strip() for w in text.strip().split(";") if w.strip()]


def any_of(words: list[str], whole: bool = False) -> str:
    """An alternation, longest first; ``whole`` asks for word boundaries around each."""
    ordered = sorted(dict.fromkeys(words), key=lambda w: (-len(w), w))
    return "|".join(rf"\b{w}\b" if whole else w for w in ordered)


def _specific(starts: str, *ends: str) -> str:
    # the alternation inside spans the whole phrase, so any word before the ending is enough; kept as published
    return "|".join(rf"{s} \s+|\w+ {e}" for e in ends for s in _words(starts))


UNITS = _words(
    "cm; fev; fvc; g / dl; g/dl; hemoglobin a1c; hour; hours; hr; hrs; index; iu / l; iu/l; kg / m2; kg/m2; kg/m<sup>2</sup>; mg / dl; mg / l; mg/dl; mg/l; minute; minutes; mins; ml; mm hg; mmhg; mmol/l; "
    "ng / ml; ng/ml; per day; per min; per month; per year; scale; score; x103 cells/mm3; year; years; yr; yrs"
)
MEASURES = _words("Hba1c; age; bmi; height; index; mean; percentile; s.d; score; sd; standard dev; standard deviation; waist; weight")
PLUS_MINUS = [*PLUS_MINUS_SIGNS, *(rf"{a}[^:alnum:]{b}" for a, b in ((r"\+", "–"), ("–", r"\+"), (r"\+", "-"), ("-", r"\+"), ("plus", "minus"), ("minus", "plus")))]
PLUS_MINUS_PATTERN = any_of(PLUS_MINUS)
CONTINUOUS = "|".join([any_of(UNITS + MEASURES, whole=True), PLUS_MINUS_PATTERN])
FOOT_CONTINUOUS = any_of(_words("mean; s.d; sd; standard dev; standard deviation"), whole=True)
SAYS_CONTINUOUS = _specific("continuous variables are; data are; values are", "mean")

_RANGES = [f"[0-9]{gap}{mark}{gap}[0-9]" for mark in ("to", "-", "–") for gap in (" ", "")] + ["!!!"]
MEDIAN_CELL = any_of(_RANGES)
MEDIAN_WORDS = any_of(["iqr", "median", "range"], whole=True)
MEDIAN = f"{MEDIAN_WORDS}|{MEDIAN_CELL}"
SAYS_MEDIAN = _specific("continuous variables are; data are; data are presented as; values are", "median")

_PEOPLE = _words(
    "african; african american; arab; asian; black; black or african american; boy; boys; caucasian; current.smoker; divorced; employed; ex.smoker; female; gender; girl; girls; gyspy; hispanic; homemaker; "
    "latino; male; married; men; non.smoker; other; percent; percentage; race; retired; sex; single; smoker; unemployed; white; widow; women; yes; [0-9] year; years [0-9] [0-9]; years [0-9][0-9] [0-9][0-9]"
)
_PERCENT_MARKS = ["^n %$", "n %$", "n % ", r"n \(%\)", r"n %\.", " % ", r" \(%\)", r" %\.", "less than.?[0-9]", "more than.?[0-9]", "<.?[0-9]", ">.?[0-9]", "<=", ">=", "≤", "≥", "≳"]
PERCENT = "|".join([any_of(_PEOPLE, whole=True), any_of(_PERCENT_MARKS)])
FOOT_PERCENT = any_of(["%", "percent", "percentage"], whole=True)
SAYS_PERCENT = _specific("data are; data are presented as; discrete variables are; values are", "count", "number", "no %")

_SIDES = [("boys", "girls"), ("f", "m"), ("female", "male"), ("left", "right")]
_NUMBER_WORDS = ["boys", "girls", "female", "male", *(f"{a}/{b}" for x, y in _SIDES for a, b in ((x, y), (y, x))), *(f"{a}:{b}" for x, y in _SIDES[2:] for a, b in ((x, y), (y, x)))]
NUMBERS = "|".join([any_of(_NUMBER_WORDS), *(f"[0-9]{a}{mark}{b}[0-9]" for mark in ":/" for a in ("", " ") for b in ("", " "))])

P_VALUE = any_of(
    [r"\* p\b", "^p across", "^p.level", "^p.t.test", "^p.val", "^p$", "^significance", r"\b\(p\)\b", r"\bnsd\b", r"\bp.<", r"\bp.=\s?\.?0", r"\bp<", r"\bp=\s?\.?0", "main effect of group", "no significant difference"]
    + ["non.significan", "p for trend", r"p\s?<\s?0\.", r"p\s?>\s?0\.", "p..value", "p.value", "pvalue", "significantly higher", "significantly lower", "statistical significan", "statistically significan"]
)
_EXTREMES = ["max", "maximum", "min..max", "min.max", "minimum", "range"]
MIN_MAX = any_of(_EXTREMES, whole=True)
MIN_MAX_WHOLE = any_of([f"^{w}$" for w in _EXTREMES])
CI = r"95%\s?c.?i.?|95%.confidence.interval|95%.credible.interval"

TRIAL = any_of(["RCT", "andomi[sz]ed controlled trial", "andomi[sz]ed trial"])
_TOTALS = ["all ", "all$", "boys", "entire", "female", "girls", "male", "men", r"model\s[0-9]", "overall", "randomi.ed population", "randomi.ed sample", "sub.total", "subtotal", "sum total", "total", "total n"]
_TOTALS += ["whole group", "whole population", "whole sample", "women"]
TOTAL, TOTAL_PREFIXED = any_of([f"^{w}" for w in _TOTALS]), any_of([f"^[a-z]{w}" for w in _TOTALS])

BASELINE = any_of(
    _words("at enrollment; at enrolment; baseline; basic information; before starting the study; characteristic; demographic; description of the sample; description of the study sample; group and control group; patient background; patients background")
    + ["subjects clinical and laboratory information"]
)
NOT_BASELINE = any_of(
    _words("approved to participate; at baseline and after; baseline adjusted; baseline adjustment; covariate analysis; criteria for assigning; declined; differences with treatment; drug information; effects of; excluded; intervention characteristics")
    + [f"{what} {how} baseline" for what in ("change", "changes") for how in ("between", "from")]
    + ["difference from baseline", "differences from baseline", "declined to participate"]
    + _words("network characteristic; nutritional characteristics; nutritional content; open.label.extension; predicted values; qualitative study; randomi.ed cross-over design; trial information; who did and did not attend")
)
SAMPLE_WORDS = any_of([r"^\s?n$", "^all$", "^baseline sample count", r"^n \(", "^n [A-Z|a-z]", "^number$", "^total$", r"^total n\b", *(f"^total number{x}" for x in ("$", " of participants", " of patients", " of subjects")), "sample size"])
SAMPLE = "|".join([SAMPLE_WORDS, r"\bn\s?:\s?[0-9]", r"\bn\s?=\s?[0-9]", r"^no\. of ", "^no of ", "^number of "])
SEM = any_of([r"s\.e\.", r"s\.e\.m\.", "se", "sem", "sems", "ses", "standard error"], whole=True)

_SPANS = ("day", "hour", "month", "week", "year")
FOLLOW_UP = any_of(
    [f"[0-9] {u}" for u in _SPANS] + [f"{u}{s} [0-9]" for u in _SPANS for s in ("", "s")] + [r"\bt1\b", "% change", "and after administration", "anova", "change following intervention", "change from baseline"]
    + ["follow.up", "followup", "manova", "percent change", "post.trial", "posttrial", "propensity.score", "regression"]
)
TEST_STATISTIC = any_of([f"{x}{gap}{y}" for x, y in (("f", "test"), ("t", "test"), ("z", "test")) for gap in (".", "")] + [r"\bdf\b", "^test$", "chi.squared", "chisquared", "f.value", "statistics", "t.value", "test.statistic", "z.value"])
NOT_TRIAL_TITLE = any_of(
    _words("^correction; ^retraction; analysis.of.untreated; case.control.stud; cohort.stud; cross.sectional; drop.out; dropout; meta.analysis; n.of.1 trial; phenotype; post.marketing.surveillance; protocol; qualitative.stud; sub.group; subgroup; survey; systematic.review")
)
NOT_TRIAL_ABSTRACT = any_of(
    _words("case.control; case.series; combined.post.hoc; consecutive.patients; cross.over; crossover; deep.learning; effect.of.baseline; exploratory.analysis; exploratory.study; machine.learning; mixed treatment comparison; non.randomi.ed; paired control")
    + _words("pooled.analysis; pooled.efficacy; practice.related.variation; prognostic.model; quasi.experimental; regional.differences; secondary.analysis; secondary.data.analysis; updated follow.up")
)
PRE_POST = r"\bpre\b|\bpost\b"
#: Within five words of each other, in either order.
BLOCKED = r"(?i)block\W+(?:\w+ ){0,5}random|random(?:i.ation|i.ed)?\W+(?:\w+ ){0,5}block"
ADAPTIVE = r"(?i)adaptive.randomi.ation"
UNWANTED_ROW = r"\bratio\b|\bsnellen equivalent\b|\b^overall\s?$\b|\b^total\s?$\b|\bgeometric mean\b|^(?:overall|total)\s?$"
WANTED_RATIO = "waist.to.hip.ratio|waist.to.height.ratio"
COMMON_LABEL = "age|height|weight|gender|sex"
EXTRA_RANGE = f"{MIN_MAX_WHOLE}|^quintile|^reference.range$|^mean.difference$"
